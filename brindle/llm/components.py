"""Classes of linked rows, by contraction on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import scratch_path


def classes(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; linked nodes share a root.

    Each round every node joins its smallest neighbour, and the edges go on
    between what the nodes have become.  Nodes must be hashes: their order is
    then random, so a round leaves about half of the nodes of even a long chain,
    and the loop ends when no edge joins two nodes.  Hot nodes shrink in
    the partial minimum, before the shuffle.
    """
    spark, folder = edges.sparkSession, scratch_path(edges.sparkSession, "classes")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    live = written(edges.select("a", "b").filter("a <> b").distinct(), "edges-0")
    hooks: list[DataFrame] = []
    while not hooks or not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(live.select(F.col("b").alias("node"), F.col("a").alias("near")))
        hook = written(both.groupBy("node").agg(F.least("node", F.min("near")).alias("root")), f"hook-{len(hooks)}")
        hooks.append(hook)
        ends = hook.select(F.col("node").alias("a"), F.col("root").alias("x"))
        other = hook.select(F.col("node").alias("b"), F.col("root").alias("y"))
        live = live.join(ends, "a").join(other, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        live = written(live.distinct(), f"edges-{len(hooks)}")
    roots = hooks[0]
    for hook in hooks[1:]:
        moved = hook.select(F.col("node").alias("root"), F.col("root").alias("new"))
        roots = roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return written(roots, "roots")
