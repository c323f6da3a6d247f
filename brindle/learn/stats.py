"""Column summaries, correlations, chi-squared tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.ordered import value_ranks
from brindle.operators.relational import attach_row, hot_keys, salted_join
from brindle.session import cut_lineage


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, sample variance, nonzeros, max, min; a single pass."""
    def one(c):
        return F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance"),
            F.sum((F.col(c) != 0).cast("long")).alias("nonzeros"), F.max(c).cast("double").alias("max"), F.min(c).cast("double").alias("min"),
        )
    return df.agg(F.array(*[one(c) for c in columns]).alias("s")).select(F.inline("s"))


def merge_summaries(parts: DataFrame) -> DataFrame:
    """Summaries (column, n, mean, variance, nonzeros, max, min) of parts merged per column, weighted by count.

    Squares are of differences of means, so a large mean does not cancel the variance.
    """
    n, c = F.sum("n"), F.col
    means = parts.groupBy("column").agg((F.sum(c("n") * c("mean")) / n).alias("__mean"))
    parts = parts.join(means, "column")
    m2 = F.sum(F.coalesce(c("variance"), F.lit(0.0)) * (c("n") - 1) + c("n") * (c("mean") - c("__mean")) ** 2)
    return parts.groupBy("column").agg(
        n.alias("n"), F.first("__mean").alias("mean"), F.when(n > 1, m2 / (n - 1)).otherwise(0.0).alias("variance"),
        F.sum("nonzeros").alias("nonzeros"), F.max("max").alias("max"), F.min("min").alias("min"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Rows (a, b, corr) for all column pairs; pearson in one pass, spearman over average ranks."""
    if method == "spearman":
        source = df = cut_lineage(df.select(*columns))  # read once per column below
        for c in columns:
            ranks = value_ranks(source.select(c), c, f"__r_{c}")
            df = salted_join(df, ranks, [c], hot=hot_keys(source, [c]))
        df = df.select(*[F.col(f"__r_{c}").alias(c) for c in columns])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in combinations(columns, 2)]
    upper = df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))
    lower = upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    ones = [(c, c, 1.0) for c in columns]
    return upper.unionAll(lower).unionAll(df.sparkSession.createDataFrame(ones, "a string, b string, corr double"))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi_squared_p(statistic: Column, freedom: Column) -> Column:
    """Probability of a statistic at least as large."""

    @F.pandas_udf("double")
    def p_value(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([upper_gamma(k / 2, v / 2) if k > 0 else 1.0 for v, k in zip(x, df)])

    return p_value(statistic.cast("double"), freedom.cast("double"))


def goodness_of_fit(observed: DataFrame, count: str, expected: str | None = None) -> DataFrame:
    """Chi-squared of observed against expected counts (rescaled; uniform if none): one row."""
    weight = F.col(expected) if expected else F.lit(1.0)
    sums = observed.agg(F.sum(count).alias("__o"), F.sum(weight).alias("__e"))
    e = weight * F.col("__o") / F.col("__e")
    joined = attach_row(observed, sums)
    return joined.agg(F.sum((F.col(count) - e) ** 2 / e).alias("statistic"), (F.count("*") - 1).alias("freedom"))


def independence(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Chi-squared of two categorical columns, per ``keys``: statistic and degrees of freedom."""
    keys = list(keys)
    cells = df.groupBy(*keys, a, b).agg(F.count("*").alias("o"))
    rows = cells.groupBy(*keys, a).agg(F.sum("o").alias("ra"))
    cols = cells.groupBy(*keys, b).agg(F.sum("o").alias("cb"))
    total = rows.groupBy(*keys).agg(F.sum("ra").alias("t"), F.count("*").alias("na"))
    width = cols.groupBy(*keys).agg(F.count("*").alias("nb"))
    # sum of (o - e)^2 / e = t * sum of o^2 / (ra * cb) - t: empty cells need no row
    parts = cells.join(rows, [*keys, a]).join(cols, [*keys, b]).groupBy(*keys).agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("s"))
    if keys:
        joined = parts.join(total, keys).join(width, keys)
    else:
        joined = attach_row(attach_row(parts, total), width)
    statistic = F.col("t") * F.col("s") - F.col("t")
    return joined.select(*keys, statistic.alias("statistic"), ((F.col("na") - 1) * (F.col("nb") - 1)).alias("freedom"))


def features_independence(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Chi-squared of every feature column against the label: rows (feature, statistic, freedom)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("v")) for f in features]))
    long = df.select(F.col(label).alias("label"), pairs.alias("p")).select("label", "p.feature", "p.v")
    return independence(long, "v", "label", ["feature"])
