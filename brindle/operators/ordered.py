"""Row numbers, running totals, ranks and sliding windows over a whole table.

None of them sends a table, or one big group, through a single task: rows are
range-partitioned on the full sort key, each range is numbered by itself, and
the totals of the earlier ranges are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut_lineage

_PART = "__part"
_POS = "__pos"
_BEFORE = "__before"


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in total order over range partitions, with the partition number.

    The input order breaks ties, so a value shared by a third of the rows still
    spreads over several ranges.  The number of ranges is left to the adaptive
    planner.  Range bounds come from a sample, so the frame is checkpointed: a
    second pass must see the same ranges.
    """
    tie = F.monotonically_increasing_id()
    ranged = (
        df.withColumn("__tie", tie)
        .repartitionByRange(*keys, *order, F.col("__tie"))
        .sortWithinPartitions(*keys, *order, F.col("__tie"))
        .drop("__tie")
        .withColumn(_POS, F.monotonically_increasing_id())
        .withColumn(_PART, F.spark_partition_id())
    )
    return cut_lineage(ranged)


def row_number_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based row number within each group of ``keys``; groups of any size.

    The table of offsets holds one row per (group, range): at most the number
    of groups plus the number of partitions.
    """
    keys = list(keys)
    ranged = _ranged(df, keys, order)
    parts = ranged.groupBy(*keys, _PART).agg(F.count("*").alias("__n"), F.min(_POS).alias("__first"))
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys, _PART, "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(_BEFORE)
    )
    if not keys:  # one row per partition: a bounded table
        parts = F.broadcast(parts)
    return (
        ranged.join(parts, on=[*keys, _PART])
        .withColumn(name, F.col(_POS) - F.col("__first") + F.col(_BEFORE) + 1)
        .drop(_POS, _PART, "__first", _BEFORE)
    )


def zip_with_index(df: DataFrame, order: Sequence[Column], name: str = "index") -> DataFrame:
    """Dense 0-based row number in the given order."""
    return row_number_by(df, [], order, name).withColumn(name, F.col(name) - 1)


def zip_frames(left: DataFrame, right: DataFrame, left_order, right_order) -> DataFrame:
    """Pair the i-th row of one frame with the i-th row of the other."""
    a = zip_with_index(left, left_order, "__i")
    b = zip_with_index(right, right_order, "__i")
    return a.join(b, "__i").drop("__i")


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Add, for each name, the running sum of its column in the given order.

    The order must be total within a group (aggregate equal values first).
    """
    keys = list(keys)
    temp = {name: f"__v{i}" for i, name in enumerate(sums)}
    ranged = _ranged(df.select("*", *[c.alias(temp[n]) for n, c in sums.items()]), keys, order)
    inside = Window.partitionBy(*keys, _PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys, _PART).agg(*[F.sum(v).alias(v) for v in temp.values()])
    parts = parts.select(
        *keys, _PART, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}b") for v in temp.values()]
    )
    if not keys:
        parts = F.broadcast(parts)
    out = ranged.select("*", *[F.sum(v).over(inside).alias(f"{v}i") for v in temp.values()])
    out = out.join(parts, on=[*keys, _PART])
    for name, v in temp.items():
        out = out.withColumn(name, F.col(f"{v}i") + F.col(f"{v}b"))
    return out.drop(_POS, _PART, *[v + s for v in temp.values() for s in ("", "i", "b")])


def value_ranks(df: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value with its 1-based average rank among all rows."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    run = running_totals(counts, keys, [F.col(value)], {"__upto": F.col("__c")})
    rank = F.col("__upto") - (F.col("__c") - 1) / F.lit(2.0)
    return run.select(*keys, value, rank.alias(name))


def average_rank(df: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add the average rank of ``value``; ties share the mean of their places."""
    return df.join(value_ranks(df, value, name, keys), on=[*keys, value])


def sliding(
    df: DataFrame, order: Sequence[Column], size: int, item: Column, name: str = "window", block_rows: int = 65536
) -> DataFrame:
    """All runs of ``size`` consecutive rows, as (start index, array of items).

    Rows are cut into index blocks; the first size-1 rows of a block are also
    given to the block before, so every window is found within one block.
    """
    block_rows = max(block_rows, size)
    rows = zip_with_index(df.select(item.alias("__item"), *_order_inputs(df)), order, "start")
    block = F.floor(F.col("start") / block_rows).cast("long")
    needed = (F.col("start") % block_rows < size - 1) & (F.col("start") >= block_rows)
    rows = rows.select(
        "start", "__item", F.explode(F.when(needed, F.array(block, block - 1)).otherwise(F.array(block))).alias("__b")
    )
    w = Window.partitionBy("__b").orderBy("start").rowsBetween(0, size - 1)
    out = rows.select("start", "__b", F.collect_list("__item").over(w).alias(name))
    return out.filter((F.size(name) == size) & (block == F.col("__b"))).select("start", name)


def _order_inputs(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]
