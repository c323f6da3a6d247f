"""Windows over event time, recomputed or kept up from per-slide partials."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def utc_instant(c: Column) -> Column:
    """Zone-less time read as UTC, as the instant type that watermarks need."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")


def windowed(df: DataFrame, time: str, size: str, slide: str | None, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates per (window, keys) with the window end as text-free timestamp column."""
    slides = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(slides.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def panes(df: DataFrame, time: str, slide: str, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Partial sums per slide-long pane: each row is read once, however far windows overlap."""
    aggs = [F.sum(c).alias(n) for n, c in sums.items()]
    return windowed(df, time, slide, None, keys, aggs).withColumnRenamed("window_end", "pane_end")


def windows_from_panes(
    pane_rows: DataFrame, keys: Sequence[str], sums: Sequence[str], count: str, size: int, slide: int
) -> DataFrame:
    """Sliding totals from pane partials by adding what enters and subtracting what leaves.

    ``size`` and ``slide`` are seconds; windows whose ``count`` fell to zero are
    dropped.  A key holds one row per pane here, never its raw rows.
    """
    end = F.unix_seconds(F.col("pane_end").cast("timestamp"))
    enter = pane_rows.select(*keys, end.alias("e"), *sums)
    leave = pane_rows.select(*keys, (end + size).alias("e"), *[(-F.col(c)).alias(c) for c in sums])
    change = enter.unionAll(leave).groupBy(*keys, "e").agg(*[F.sum(c).alias(c) for c in sums])
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("e")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    totals = change.select(*keys, "e", F.lead("e").over(w).alias("next"), *[F.sum(c).over(upto).alias(c) for c in sums])
    alive = totals.filter((F.col(count) > 0) & F.col("next").isNotNull())
    ends = F.explode(F.sequence(F.col("e"), F.col("next") - slide, F.lit(slide).cast("long")))
    filled = alive.select(ends.alias("e"), *keys, *sums)
    return filled.select(F.timestamp_seconds("e").alias("window_end"), *keys, *sums)
