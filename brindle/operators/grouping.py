"""Keyed collection operators: lists per key, cogroup, general folds, tree aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_ROWS = 100_000


def group_lists(
    df: DataFrame, key: str | Sequence[str], value: Column, name: str = "values", max_rows: int = LIST_ROWS
) -> DataFrame:
    """Values of each key as (key, chunk, sorted list).

    A key with up to ``max_rows`` rows gives one list, chunk 0.  A bigger key
    gives several chunks, so that no list outgrows a task; all values stay.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return _chunked_lists(df, keys, value, name, max_rows).drop("chunks")


def _chunked_lists(df: DataFrame, keys: list[str], value: Column, name: str, max_rows: int) -> DataFrame:
    """(keys, chunk, chunks, list).

    Rows of a big key are counted by value first and numbered within it, so
    which chunk a row goes to depends on its content alone, a retried task places
    it alike, and a value that repeats spreads too.
    """
    rows = df.select(*keys, value.alias("__value"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    big = counts.filter(F.col("__n") > max_rows)
    chunks = F.ceil(F.col("__n") / max_rows * 2).cast("int")
    big = big.select(*[F.col(k).alias(f"__{k}") for k in keys], chunks.alias("chunks"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    lists = F.sort_array(F.collect_list("__value")).alias(name)
    small = rows.join(big, same, "left_anti").groupBy(*keys).agg(lists)
    small = small.select(*keys, F.lit(0).alias("chunk"), F.lit(1).alias("chunks"), name)
    values = rows.join(big, same).groupBy(*keys, "chunks", "__value").agg(F.count("*").alias("__n"))
    each = values.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    placed = each.withColumn("chunk", F.pmod(F.xxhash64("__value", "__i"), F.col("chunks")).cast("int"))
    return small.unionByName(placed.groupBy(*keys, "chunk", "chunks").agg(lists).select(*keys, "chunk", "chunks", name))


def cogroup(key: str, sides: dict[str, tuple[DataFrame, Column]], max_rows: int = LIST_ROWS) -> DataFrame:
    """Per key the list of values of every side; an empty list where a side has none.

    A key with more than ``max_rows`` rows on a side has a row for every
    combination of the sides' chunks, so that every value of one side stands
    beside every value of the others, whatever ``max_rows`` is.  ``chunk``
    numbers the combinations; it is 0 for keys with one list per side.
    """
    out = None
    for name, (df, value) in sides.items():
        lists = _chunked_lists(df, [key], value, name, max_rows)
        lists = lists.withColumnsRenamed({"chunk": f"__c_{name}", "chunks": f"__n_{name}"})
        out = lists if out is None else out.join(lists, key, "full")
    chunk = F.lit(0).cast("long")
    for name in sides:
        out = out.withColumn(name, F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)))
        chunk = chunk * F.coalesce(f"__n_{name}", F.lit(1)) + F.coalesce(f"__c_{name}", F.lit(0))
    return out.select(key, chunk.alias("chunk"), *sides)


def fold_by_key(
    df: DataFrame,
    keys: Sequence[str],
    seq: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    fan_in: int = 256,
    flush_rows: int = 200_000,
) -> DataFrame:
    """General associative, commutative fold.

    ``seq`` reduces any frame with the columns of ``schema`` to one row per key,
    and its own output is valid input again.  Rows are reduced where they lie,
    in frames of up to ``flush_rows`` rows, then by (key, salt), then by key, so a
    hot key arrives at its last task as at most ``fan_in`` rows.  Both times the
    rows come sorted by key, from runs that the engine spills and merges; a task
    holds one batch and the key that is still open, however many keys it has.
    """
    columns = [F.col(k) for k in keys]

    def reduce_here(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            kept = seq(batch if kept is None else pd.concat([kept, batch], ignore_index=True))
            if len(kept) > flush_rows:
                yield kept
                kept = None
        if kept is not None:
            yield kept

    def reduce_sorted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = None
        for batch in batches:
            rows = batch if open_ is None else pd.concat([open_, batch], ignore_index=True)
            if not len(rows):
                continue
            last = rows.iloc[[-1]][list(keys)]
            same = pd.Series(True, index=rows.index)
            for k in keys:
                value = last[k].iloc[0]
                same &= rows[k].isna() if pd.isna(value) else rows[k] == value
            if not same.all():
                yield seq(rows[~same].reset_index(drop=True))
            open_ = seq(rows[same].reset_index(drop=True))
        if open_ is not None:
            yield open_

    part = df.mapInPandas(reduce_here, schema)
    # The number of the partition spreads a hot key and is the same when the task runs again.
    part = part.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(fan_in))).repartition(*columns, F.col("__salt")).drop("__salt")
    part = part.sortWithinPartitions(*columns) if columns else part
    part = part.mapInPandas(reduce_sorted, schema)
    part = part.repartition(*columns).sortWithinPartitions(*columns) if columns else part.repartition(1)
    return part.mapInPandas(reduce_sorted, schema)


def tree_aggregate(
    df: DataFrame, partial: list[Column], merge: list[Column], depth: int = 2, scale: int = 16
) -> DataFrame:
    """Global aggregate through ``depth`` levels of partial results.

    ``partial`` aggregates rows into named columns, ``merge`` aggregates those
    columns into columns of the same names.
    """
    level = df.groupBy(F.pmod(F.spark_partition_id(), scale ** (depth - 1)).alias("__node")).agg(*partial)
    for d in range(depth - 2, 0, -1):
        level = level.groupBy(F.pmod(F.col("__node"), scale**d).alias("__node")).agg(*merge)
    return level.agg(*merge)
