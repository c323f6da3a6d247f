"""Stream sources: sockets, a queue of batches, constant rows, two streams that advance together, closing rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.relational import bounded_cross
from brindle.session import scratch_path


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines that a server at host:port sends; not restartable, for trials only."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def socket_records(spark: SparkSession, host: str, port: int, convert: Column) -> DataFrame:
    """Socket lines turned into records by an expression over the column ``value``."""
    return socket_lines(spark, host, port).select(convert.alias("record")).filter("record IS NOT NULL")


class BatchQueue:
    """Frames that become the micro-batches of a stream, one after the other.

    The frame is written once, partitioned by batch, to a folder beside the one
    that ``stream`` reads; a feed moves the next batch over.  A runner that calls
    one feed before each run sees one batch at a time, one that calls all of
    them first sees a single batch.
    """

    def __init__(self, df: DataFrame, batch: Column, count: int, label: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.folder, self.waiting = scratch_path(self.spark, label), scratch_path(self.spark, f"{label}-waiting")
        df.limit(0).write.parquet(f"{self.folder}/start")
        df.withColumn("__b", batch.cast("long")).write.partitionBy("__b").parquet(self.waiting)
        self.stream = self.spark.readStream.schema(df.schema).parquet(f"{self.folder}/*")
        self.feeds = [partial(self._feed, i) for i in range(count)]

    def _feed(self, number: int) -> None:
        """A batch without rows comes as an empty file; one that has come is not moved again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        source, target = path(f"{self.waiting}/__b={number}"), path(f"{self.folder}/batch-{number}")
        files = source.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(target):
            return
        if not files.exists(source):
            self.spark.createDataFrame([], self.schema).write.parquet(str(target))
        elif not files.rename(source, target):
            raise OSError(f"batch {number} could not be moved to {target}")


def constant_stream(ticks: DataFrame, rows: DataFrame) -> DataFrame:
    """The same small static rows for every row of a tick stream (such as ``rate``)."""
    return bounded_cross(ticks, rows, 10_000)


class Closing:
    """A stream with an end: ``feeds`` bring rows from after all others, so that the watermark passes what is open.

    ``mark`` has values for columns of these rows; those that take part in a
    join must match nothing.  The other columns are null, by which a query
    leaves the rows out of its result.  The first feed moves the watermark, the
    second makes a batch that uses it; what the rows hold open is never closed.
    """

    def __init__(self, stream: DataFrame, time: str, mark: Mapping[str, Any], label: str, end: str = "2200-01-01 00:00:00"):
        self.spark, self.schema, self.folder = stream.sparkSession, stream.schema, scratch_path(stream.sparkSession, label)
        self.spark.createDataFrame([], self.schema).write.parquet(f"{self.folder}/start")
        self.values = dict(mark) | {time: F.lit(end).cast(self.schema[time].dataType)}
        self.stream = stream.unionByName(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/*"))
        self.feeds = [partial(self._feed, i) for i in range(2)]

    def _feed(self, number: int) -> None:
        values = [(v if isinstance(v := self.values.get(f.name), Column) else F.lit(v)).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*values).write.mode("overwrite").parquet(f"{self.folder}/end-{number}")


def together(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two streams as one whose batches hold what is new on both sides; see :func:`by_side`."""
    sides = [("left", left), ("right", right)]
    rows = [df.select(*[(F.struct(*d.columns) if n == name else F.lit(None).cast(d.schema)).alias(n) for n, d in sides]) for name, df in sides]
    return rows[0].unionByName(rows[1])


def by_side(combine: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """``combine(left, right)`` as a function of a batch of :func:`together`; a side without new rows is empty."""

    def run(batch: DataFrame) -> DataFrame:
        return combine(*[batch.filter(F.col(n).isNotNull()).select(f"{n}.*") for n in ("left", "right")])

    return run
