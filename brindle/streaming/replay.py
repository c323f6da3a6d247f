"""Run a stream to the end of its input and read the result back as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.relational import attach_row
from brindle.session import scratch_path

BATCH = "__batch"


def file_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Stream over the files of a folder (or one file); parquet schemas come from the files.

    A table path may be a single file; as a glob it is accepted like a folder.
    """
    if schema is None:
        schema = spark.read.format(fmt).load(path).schema
    if path.endswith(f".{fmt}"):
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


#: State in RocksDB files; a commit writes its changes, and a batch without data does not run.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession, **more: str) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; ``more`` are further settings, dots written as ``__``."""
    wanted = STATE_ON_DISK | {f"spark.sql.streaming.{k.replace('__', '.')}": v for k, v in more.items()}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_at_intervals(
    stream: DataFrame, write: Callable[[DataFrame, int], None], label: str, interval: str, feeds: Sequence[Callable[[], None]],
    mode: str = "append", checkpoint: str | None = None,
) -> str:
    """Run ``write(batch, batch_id)`` at the ticks of a processing-time trigger; returns the checkpoint folder.

    The query stays up while each of ``feeds`` brings data, and is stopped when
    all that has come is done.  Ticks without new data run no batch.
    """
    checkpoint = checkpoint or scratch_path(stream.sparkSession, f"{label}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    running = writer.trigger(processingTime=interval).foreachBatch(write).start()
    try:
        for feed in feeds:
            feed()
            running.processAllAvailable()
    finally:
        running.stop()
    return checkpoint


def run_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], label: str, mode: str = "append",
    checkpoint: str | None = None, feeds: Sequence[Callable[[], None]] = (),
) -> str:
    """Process what is available through ``write(batch, batch_id)``; returns the checkpoint folder.

    With ``feeds`` the query is run once after each of them, going on from its
    checkpoint, so that every feed is a micro-batch of its own.
    """
    checkpoint = checkpoint or scratch_path(stream.sparkSession, f"{label}-state")
    for feed in feeds or [lambda: None]:
        feed()
        running = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        running.awaitTermination()
    return checkpoint


def run_to_table(
    stream: DataFrame, label: str, mode: str = "append", keys: Sequence[str] = (), checkpoint: str | None = None,
    out: str | None = None, feeds: Sequence[Callable[[], None]] = (),
) -> DataFrame:
    """Result of a stream as a table.

    Each micro-batch is written to its own folder, so a batch that is run again
    after a failure replaces itself.  In update mode the last row of each key
    stands; in complete mode, the last batch.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, f"{label}-out")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    run_batches(stream, write, label, mode, checkpoint, feeds)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField(BATCH, T.LongType())])).parquet(out)
    if mode == "complete":
        last = rows.agg(F.max(BATCH).alias(BATCH))
        return attach_row(rows.withColumnRenamed(BATCH, "__at"), last).filter(F.col("__at") == F.col(BATCH)).drop("__at", BATCH)
    if mode == "update":
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), BATCH).alias("__r"))
        return newest.select("__r.*").drop(BATCH)
    return rows.drop(BATCH)
