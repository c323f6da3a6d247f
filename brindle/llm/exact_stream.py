"""Exact deduplication as a stream with keyed state on disk."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import empty_if_null
from brindle.session import scratch_path
from brindle.streaming.replay import file_stream

#: Executors keep the state in RocksDB files and not on the heap.  Files are not allocated ahead,
#: which would cost megabytes for each of many small stores, and a commit writes its changes alone.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column | str) -> Column:
    """Runs of ASCII white space become one space; a null is the empty text."""
    return F.regexp_replace(empty_if_null(text), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column | str) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def first_of_each_digest(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream of (doc_id, digest, file, row) to its present end and return the state it reached.

    The state has one entry per digest and never expires: the digest, the
    smallest doc_id, where that row's content lies (file and row number) and
    the number of rows.  Each micro-batch writes the entries it touched to a
    folder of its own, so a batch that is repeated after a failure replaces
    itself; a restart with the same ``folder`` goes on from the checkpoint.
    """
    spark = stream.sparkSession
    entry = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    state = stream.groupBy("digest").agg(F.min(entry).alias("first"), F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/touched/batch={number}")

    with _state_on_disk(spark):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    touched = spark.read.schema(f"digest binary, first {state.schema['first'].dataType.simpleString()}, n bigint, batch bigint")
    # Entries only grow: the smallest first row and the largest count are the latest.
    latest = touched.parquet(f"{folder}/touched").groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))
    return latest.select("digest", "n", F.col("first.doc_id").alias("keep_id"), F.col("first.file").alias("keep_file"), F.col("first.row").alias("keep_row"))


def exact_dedup(
    spark: SparkSession,
    path: str,
    *,
    batches: int = 4,
    max_bytes: int = 64 << 30,
    max_files: int | None = None,
    digest=digest_of,
    folder: str | None = None,
) -> DataFrame:
    """One row per document of the parquet table at ``path``.

    Columns: doc_id, digest, keep_id, keep_file, keep_row, group_size, kept.
    Texts are equal when they are after :func:`normalised`; the row with the
    smallest doc_id stays.  Every hit is checked on the full bytes: the texts
    of a digest that occurs more than once are compared, and where they differ
    the group is split by the text itself.  ``digest`` may be replaced by a
    weaker expression of the text; the result does not depend on it.

    The stream takes a ``batches``-th part of the table's bytes per micro-batch,
    or ``max_bytes`` if that is less, or ``max_files``; each later batch meets
    the state that the earlier ones have left.  A file is never split between
    batches.  The state has as many stores as the session has shuffle partitions
    when the stream first starts, and keeps that number: choose it so that a
    store holds some millions of digests of the finished table.

    Nulls: a null text is empty, a null doc_id sorts after all others.  Rows
    that share the smallest doc_id of their group are one document and are all
    kept.  An empty table gives an empty result; other columns are not read.
    """
    folder = folder or scratch_path(spark, "exact-stream")
    docs = spark.read.parquet(path)
    schema = docs.select("doc_id", "text").schema
    if max_files:
        limit = {"maxFilesPerTrigger": str(max_files)}
    else:
        files = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
        total = files.agg(F.sum("size")).first()[0] or 1
        limit = {"maxBytesPerTrigger": str(min(max_bytes, -(-total // batches)))}
    stream = file_stream(spark, path, schema=schema, **limit).select(
        "doc_id",
        digest("text").alias("digest"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    state = first_of_each_digest(stream, folder)
    rows = docs.select("doc_id", digest("text").alias("digest"), *_place())
    rows.join(state, "digest", "left").write.parquet(f"{folder}/located")
    located = spark.read.parquet(f"{folder}/located").withColumnRenamed("n", "group_size")
    unequal = _digests_of_unequal_texts(docs, located)
    unequal.write.parquet(f"{folder}/unequal")
    unequal = spark.read.parquet(f"{folder}/unequal")
    light = located.drop("file", "row")
    if not unequal.isEmpty():
        light = light.join(unequal, "digest", "left_anti").unionByName(_grouped_by_text(docs, located, unequal))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return light.withColumn("kept", kept)


def _place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def _texts_at(docs: DataFrame, located: DataFrame) -> DataFrame:
    """The normalised bytes of located rows.  File and row number are unique, so no key is hot here."""
    texts = docs.select(*_place(), normalised("text").cast("binary").alias("bytes"))
    return located.join(texts, ["file", "row"])


def _digests_of_unequal_texts(docs: DataFrame, located: DataFrame) -> DataFrame:
    """Digests whose hits are not the same text byte for byte.

    Only texts of repeated digests are compared.  Each task reduces its texts
    of a digest to the smallest and the largest before the shuffle, so a group
    that holds a third of all rows sends two texts per task.
    """
    hits = _texts_at(docs, located.filter("group_size > 1").select("digest", "file", "row"))
    ends = hits.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    return ends.filter("low <> high").select("digest")


def _grouped_by_text(docs: DataFrame, located: DataFrame, unequal: DataFrame) -> DataFrame:
    """Rows whose digest met unequal texts, grouped again by the full text."""
    met = located.join(unequal, "digest", "left_semi").select("doc_id", "digest", "file", "row")
    rows = _texts_at(docs, met)
    entry = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    groups = rows.groupBy("digest", "bytes").agg(F.min(entry).alias("first"), F.count("*").alias("group_size"))
    return rows.join(groups, ["digest", "bytes"]).select(
        "doc_id",
        "digest",
        F.col("first.doc_id").alias("keep_id"),
        F.col("first.file").alias("keep_file"),
        F.col("first.row").alias("keep_row"),
        "group_size",
    )
