"""Relational operators whose older semantics differ from the platform's, and skew-safe joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEY_LIMIT = 1000
HOT_ROWS = 1000


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a frame that is one row, such as a global aggregate, to every row."""
    return df.crossJoin(F.broadcast(row))


def auto_alias(df: DataFrame, *exprs: Column | str) -> DataFrame:
    """Select expressions, naming the unnamed ones c0, c1, ... by position."""
    out = []
    for i, e in enumerate(exprs):
        out.append(F.col(e) if isinstance(e, str) else e.alias(f"c{i}"))
    return df.select(*out)


def all_columns_equal(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of two frames by position."""
    pairs = zip(left.columns, right.columns, strict=True)
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def except_keep_duplicates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that do not occur in ``right``; left duplicates stay.

    The right side is made distinct first, so a row repeated there many times
    crosses the shuffle once.
    """
    seen = right.toDF(*[f"__r{i}" for i in range(len(right.columns))]).distinct()
    return left.join(seen, all_columns_equal(left, seen), "left_anti")


def intersect_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def union_all_of(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_KEY_LIMIT) -> DataFrame:
    """Keys that hold more than 1/limit of the rows: fewer than ``limit`` of them, with a number of salts.

    Counting is partial before the shuffle; the total comes from the counts, so
    the input is read once.
    """
    return hot_from_counts(df.groupBy(*keys).agg(F.count("*").alias("__n")), keys, limit)


def hot_from_counts(counts: DataFrame, keys: Sequence[str], limit: int = HOT_KEY_LIMIT) -> DataFrame:
    """The hot keys of a frame of counts (keys, __n)."""
    total = counts.agg(F.sum("__n").alias("__total"))
    share = F.col("__n") / F.col("__total")
    hot = attach_row(counts, total).filter(F.col("__n") > F.greatest(F.col("__total") / limit, F.lit(HOT_ROWS)))
    return hot.select(*keys, F.least(F.ceil(share * limit), F.lit(limit)).cast("int").alias("__salts"))


def add_salt(big: DataFrame, hot: DataFrame, keys: Sequence[str], name: str = "__salt", distinct: bool = False) -> DataFrame:
    """Rows of hot keys spread over the salts that :func:`hot_keys` grants; 0 for the rest.

    Equal rows of a hot key are counted, which is partial before the shuffle,
    and numbered; the salt is a hash of the content and that number.  So equal
    rows spread too, and a task that is tried again places its rows alike.
    ``distinct`` says that no two rows are equal: then the content alone gives
    the salt, and the input is read once.
    """
    columns = big.columns
    marked = big.join(F.broadcast(hot), list(keys), "left")
    content = [F.col(c) for c in columns]
    if distinct:
        spread = F.pmod(F.xxhash64(*content), F.col("__salts")).cast("int")
        return marked.select(*columns, F.coalesce(spread, F.lit(0)).alias(name))
    cold = marked.filter("__salts IS NULL").select(*columns, F.lit(0).alias(name))
    equal = marked.filter("__salts IS NOT NULL").groupBy(*columns, "__salts").agg(F.count("*").alias("__n"))
    warm = equal.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    spread = F.pmod(F.xxhash64(*content, F.col("__i")), F.col("__salts")).cast("int")
    return cold.unionByName(warm.select(*columns, spread.alias(name)))


def repeat_per_salt(small: DataFrame, hot: DataFrame, keys: Sequence[str], name: str = "__salt") -> DataFrame:
    """The other side of a salted join: a row of a hot key once for every salt."""
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    return small.join(F.broadcast(hot), list(keys), "left").withColumn(name, every).drop("__salts")


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", hot: DataFrame | None = None, distinct: bool = False
) -> DataFrame:
    """Join whose big side may hold a third of its rows under one key.

    Hot keys (fewer than 1,000, so broadcast is safe) get several salts; their
    rows on the other side are repeated once per salt.  Valid for joins that
    keep the big side: inner, left, left_semi, left_anti.  ``hot`` spares the
    count of the big side where its hot keys are known already; ``distinct`` says
    that no two rows of the big side are equal.  The sides are merged: both may be
    too large to pass through the driver.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    keys = list(keys)
    hot = hot_keys(big, keys) if hot is None else hot
    left, right = add_salt(big, hot, keys, distinct=distinct), repeat_per_salt(small, hot, keys)
    return left.join(right.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def bounded_cross(left: DataFrame, right: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Cartesian product with a right side proven to be at most ``max_rows``."""
    if right.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"the right side of a cartesian product is limited to {max_rows} rows")
    return left.crossJoin(F.broadcast(right))


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast hint behind a row count; beyond the bound the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def range_join(
    points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float
) -> DataFrame:
    """Pairs with low <= point < high, through an equi join on buckets of ``width``.

    Each range is repeated once per bucket it touches; the exact condition then
    filters, so the result does not depend on ``width``.
    """
    bucket = F.floor(F.col(point).cast("double") / width)
    first = F.floor(F.col(low).cast("double") / width)
    last = F.floor(F.col(high).cast("double") / width)
    p = points.withColumn("__bucket", bucket)
    r = ranges.filter(F.col(low) < F.col(high)).withColumn("__bucket", F.explode(F.sequence(first, last)))
    inside = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    return p.join(r, "__bucket").filter(inside).drop("__bucket")


def spread_out(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as there are cores, for work that is long per row, where the input has fewer splits.

    A large input has more splits than that and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
