"""Samples: exact sizes, strata, ranges of the unit interval, folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import cut_lineage

from brindle.operators.ordered import row_number_by


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """Repeatable pseudo-random number in [0, 1) made from the given columns."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def take_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` random rows without replacement (all rows if fewer)."""
    return df.withColumn("__u", F.rand(seed)).orderBy("__u").limit(n).drop("__u")


def take_sample_with_replacement(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` random rows with replacement: Poisson oversample, then cut to n."""
    total = df.count()
    if not total:
        return df.limit(0)
    rate = (n + 6 * n**0.5 + 12) / total
    return take_sample(df.sample(True, rate, seed), n, seed + 1)


def exact_stratified_sample(df: DataFrame, key: str, fractions: Mapping, order: Sequence[Column]) -> DataFrame:
    """ceil(fraction * size) rows of every listed stratum, lowest ``order`` first.

    Strata may be of any size: ranks come from the range-partitioned numbering.
    """
    parts = [x for k, v in fractions.items() for x in (F.lit(k), F.lit(float(v)))]
    fraction = F.try_element_at(F.create_map(*parts), F.col(key))
    listed = df.filter(fraction.isNotNull())
    sizes = listed.groupBy(key).agg(F.count("*").alias("__size"))
    ranked = row_number_by(listed, [key], order, "__rank")
    kept = ranked.join(F.broadcast(sizes), key)  # one row per listed stratum
    return kept.filter(F.col("__rank") <= F.ceil(fraction * F.col("__size"))).drop("__rank", "__size")


def unit_range_sample(df: DataFrame, low: float, high: float, seed: int, complement: bool = False) -> DataFrame:
    """Rows whose random number falls in [low, high), or all the others."""
    inside = (F.col("__u") >= low) & (F.col("__u") < high)
    # one column per row: two uses of rand() in one filter would draw twice
    return df.withColumn("__u", F.rand(seed)).filter(~inside if complement else inside).drop("__u")


def k_folds(df: DataFrame, k: int, seed: int) -> list[tuple[DataFrame, DataFrame]]:
    """k pairs (train, validation); the validation parts divide the table.

    The numbers are drawn once and written, so all folds agree on them and the input is read once.
    """
    drawn = cut_lineage(df.withColumn("__fold", F.floor(F.rand(seed) * k).cast("int")))
    return [(drawn.filter(F.col("__fold") != i).drop("__fold"), drawn.filter(F.col("__fold") == i).drop("__fold")) for i in range(k)]


def bucket_sample(df: DataFrame, x: int, y: int, *cols: str) -> DataFrame:
    """Bucket x of y (1-based) by hash of the columns: exact and repeatable."""
    return df.filter(F.pmod(F.xxhash64(*cols), F.lit(y)) == x - 1)


def reservoir_per_partition(df: DataFrame, k: int, seed: int) -> DataFrame:
    """k uniform rows of every input partition, with that partition's row count."""
    cols = df.columns

    def run(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        kept, count = None, 0
        for batch in batches:
            count += len(batch)
            batch = batch.assign(__u=rng.random(len(batch)))
            kept = batch if kept is None else pd.concat([kept, batch])
            kept = kept.nsmallest(k, "__u")
        if kept is not None:
            yield kept[cols].assign(partition_rows=count)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, partition_rows bigint")
