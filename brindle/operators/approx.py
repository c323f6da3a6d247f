"""Estimates with stated bounds, taken from a Bernoulli sample of the rows.

Every result is a row (mean, low, high, confidence), per key where asked.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _z(confidence: float) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def _bounds(df: DataFrame, keys: Sequence[str], mean, spread, confidence: float) -> DataFrame:
    z = _z(confidence)
    return df.select(
        *keys,
        mean.alias("mean"),
        (mean - z * spread).alias("low"),
        (mean + z * spread).alias("high"),
        F.lit(confidence).alias("confidence"),
    )


def approx_count(
    df: DataFrame, keys: Sequence[str] = (), fraction: float = 0.1, confidence: float = 0.95, seed: int = 0
) -> DataFrame:
    """Row count (per key) scaled up from the sample, with its binomial spread."""
    n = df.sample(False, fraction, seed).groupBy(*keys).agg(F.count("*").alias("n"))
    spread = F.sqrt(F.col("n") * (1 - fraction)) / fraction
    return _bounds(n, keys, F.col("n") / fraction, spread, confidence)


def approx_mean(
    df: DataFrame, value: str, keys: Sequence[str] = (), fraction: float = 0.1, confidence: float = 0.95, seed: int = 0
) -> DataFrame:
    """Mean (per key) with the standard error of the sampled values."""
    s = df.sample(False, fraction, seed).groupBy(*keys)
    s = s.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    return _bounds(s, keys, F.col("m"), F.sqrt(F.col("v") / F.col("n")), confidence)


def approx_sum(
    df: DataFrame, value: str, keys: Sequence[str] = (), fraction: float = 0.1, confidence: float = 0.95, seed: int = 0
) -> DataFrame:
    """Sum (per key): scaled sample sum, spread of a Bernoulli sample's total."""
    s = df.sample(False, fraction, seed).groupBy(*keys)
    s = s.agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    spread = F.sqrt((1 - fraction) * F.col("ss")) / fraction
    return _bounds(s, keys, F.col("s") / fraction, spread, confidence)
