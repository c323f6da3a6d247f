"""Histograms with a closed last bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.relational import attach_row


def even_histogram(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Rows (bucket, low, high, n): even buckets from min to max, empty ones with n = 0."""
    bounds = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    place = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("__lo")) * buckets / span), F.lit(buckets - 1))
    )
    counts = (
        attach_row(df.filter(F.col(value).isNotNull()), bounds)
        .groupBy(place.cast("int").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    frame = bounds.select("__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return frame.join(F.broadcast(counts), "bucket", "left").select(
        "bucket",
        (F.col("__lo") + span * F.col("bucket") / buckets).alias("low"),
        (F.col("__lo") + span * (F.col("bucket") + 1) / buckets).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def bound_histogram(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """Rows (bucket, low, high, n) for given ascending bounds; values outside are not counted."""
    last = len(bounds) - 2
    place = None
    for i in range(last + 1):
        upper = F.col(value) <= bounds[i + 1] if i == last else F.col(value) < bounds[i + 1]
        hit = (F.col(value) >= bounds[i]) & upper
        place = F.when(hit, i) if place is None else place.when(hit, i)
    counts = df.groupBy(place.alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("bucket").isNotNull())
    limits = F.array(*[F.lit(float(b)) for b in bounds])
    frame = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bucket"))
    return frame.join(F.broadcast(counts), "bucket", "left").select(
        "bucket",
        F.get(limits, F.col("bucket")).alias("low"),
        F.get(limits, F.col("bucket") + 1).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
