"""Heavy hitters of a stream from a count-min sketch that is merged batch by batch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.streaming.replay import run_batches
from brindle.session import scratch_path

ROW = "r int, cells array<long>"


class CountMin:
    """A sketch as a frame of ``depth`` rows (r, cells) with ``width`` counters each.

    A key adds to one counter in each row; its estimate is the smallest of them.
    That is never below its count, and with a chance of 1 - ``delta`` not more
    than ``eps`` times the number of rows above it.
    """

    def __init__(self, key: str, eps: float, delta: float, seed: int = 0):
        self.key, self.seed = key, seed
        self.width, self.depth = math.ceil(math.e / eps), max(1, math.ceil(math.log(1 / delta)))

    def cell(self, r: Column | int) -> Column:
        row = F.lit(r) if isinstance(r, int) else r
        return F.pmod(F.xxhash64(F.lit(self.seed), row, F.col(self.key)), F.lit(self.width)).cast("int")

    def of(self, counts: DataFrame) -> DataFrame:
        """Sketch of rows (key, n): counters are summed in each task before the shuffle."""
        at = counts.select(F.posexplode(F.array(*[self.cell(r) for r in range(self.depth)])).alias("r", "cell"), "n")
        return self._rows(at.groupBy("r", "cell").agg(F.sum("n").alias("n")))

    def _rows(self, cells: DataFrame) -> DataFrame:
        """At most depth * width counters, put in the order of their cells."""
        pairs = cells.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"))
        every = F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
        return pairs.select("r", every.alias("cells"))

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Counters of both added up; a sketch of no rows is an empty frame."""
        both = a.withColumnRenamed("cells", "a").join(b.withColumnRenamed("cells", "b"), "r", "full")
        return both.select("r", F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(F.zip_with("a", "b", lambda x, y: x + y)).alias("cells"))

    def estimates(self, sketch: DataFrame, keys: DataFrame) -> DataFrame:
        """(key, estimate) of distinct keys; the sketch, of a fixed size, goes to every task as one row."""
        one = sketch.agg(F.map_from_entries(F.collect_list(F.struct("r", "cells"))).alias("__sketch"))
        found = keys.select(self.key).join(F.broadcast(one), how="cross")
        looked_up = [F.coalesce(F.get(F.try_element_at("__sketch", F.lit(r)), self.cell(r)), F.lit(0).cast("long")) for r in range(self.depth)]
        least = F.least(*looked_up) if self.depth > 1 else looked_up[0]
        return found.select(self.key, least.alias("estimate"))


class HeavyHitters:
    """Keys with at least ``share`` of the rows, of every micro-batch and of the whole stream, from sketches alone.

    Beside the merged sketch there is a set of candidates: a key comes in when
    its estimate within a batch reaches ``share`` of the batch, and stays while
    its estimate over all batches reaches ``share`` of all rows.  A key with that
    share of the stream has it in some batch after any point at which it
    had not, so none is missed; there are at most about 1 / (share - eps) of
    them.  Version n of sketch and candidates is made from version n - 1 and
    batch n, so a batch that runs again gives the same; both are kept with the
    checkpoint of the stream.
    """

    def __init__(self, key: str, share: float, eps: float | None = None, delta: float = 0.001, seed: int = 0):
        self.key, self.share = key, share
        self.sketch = CountMin(key, eps or share / 10, delta, seed)

    def run(self, stream: DataFrame, label: str, checkpoint: str | None = None, feeds=()) -> tuple[DataFrame, str]:
        """Process what is available; returns rows (batch, key, estimate, total) and the checkpoint folder.

        ``batch`` is the number of the micro-batch, or -1 for the whole stream so
        far; ``total`` is the number of rows the estimate is a part of.
        """
        spark = stream.sparkSession
        checkpoint = checkpoint or scratch_path(spark, f"{label}-state")
        folder = f"{checkpoint}/heavy"
        key_type = dict(stream.dtypes)[self.key]

        def step(batch: DataFrame, number: int) -> None:
            self._step(batch.sparkSession, batch, number, folder, key_type)

        run_batches(stream.select(self.key), step, label, checkpoint=checkpoint, feeds=feeds)
        rows = spark.read.parquet(f"{folder}/hitters")
        last = rows.agg(F.max("version")).first()[0]
        whole = rows.filter((F.col("version") == last) & (F.col("batch") == -1))
        return rows.filter("batch >= 0").unionByName(whole).select("batch", self.key, "estimate", "total"), checkpoint

    def _step(self, spark: SparkSession, batch: DataFrame, number: int, folder: str, key_type: str) -> None:
        sketch = self.sketch
        # Partial counts within a task: one key's rows come together before the counters do.
        counts = batch.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.count("*").alias("n"))
        sketch.of(counts).write.mode("overwrite").parquet(f"{folder}/batch/{number % 3}")
        new = spark.read.schema(ROW).parquet(f"{folder}/batch/{number % 3}")
        if number:
            old = spark.read.schema(ROW).parquet(f"{folder}/sketch/{(number - 1) % 3}")
            kept = spark.read.parquet(f"{folder}/hitters/version={number - 1}").filter("batch = -1").select(self.key)
        else:
            old, kept = spark.createDataFrame([], ROW), spark.createDataFrame([], f"`{self.key}` {key_type}")
        sketch.merged(old, new).write.mode("overwrite").parquet(f"{folder}/sketch/{number % 3}")
        whole = spark.read.schema(ROW).parquet(f"{folder}/sketch/{number % 3}")
        size = F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + x)
        here = self._hitters(new, counts, new.agg(F.max(size)).first()[0] or 0).withColumn("batch", F.lit(number))
        total = whole.agg(F.max(size)).first()[0] or 0
        candidates = here.select(self.key).unionAll(kept).distinct()
        overall = self._hitters(whole, candidates, total).withColumn("batch", F.lit(-1))
        here.unionByName(overall).write.mode("overwrite").parquet(f"{folder}/hitters/version={number}")

    def _hitters(self, sketch: DataFrame, keys: DataFrame, total: int) -> DataFrame:
        found = self.sketch.estimates(sketch, keys).filter(F.col("estimate") >= math.ceil(self.share * total))
        return found.withColumn("total", F.lit(total).cast("long"))
