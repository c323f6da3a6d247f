"""Texts in chunks: a stored table whose rows meet what other tasks answer to them, without a shuffle of the texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.llm.common import chunked
from brindle.session import scratch_path


def numbered_chunks(batches: Iterable[pa.RecordBatch], text: str, size: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of a task in chunks of about ``size`` bytes of text, each with a number that no other task gives."""
    number, part, held = TaskContext.get().partitionId() << 32, [], 0
    for batch in chunked(batches, text, size):
        got = batch.column(text).nbytes
        if part and held + got > size:
            yield number, part
            number, part, held = number + 1, [], 0
        part.append(batch)
        held += got
    if part:
        yield number, part


def with_chunk(df: DataFrame, text: str, size: int) -> DataFrame:
    """``df`` with a column ``chunk``: rows that a task has read one after another, about ``size`` bytes of text.

    The numbers hold for one run of the task; write the frame before it is used twice.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("chunk", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in numbered_chunks(batches, text, size):
            for batch in part:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, number))], schema.names)

    return df.mapInArrow(run, schema)


def stored_by_chunk(df: DataFrame, buckets: int, label: str) -> DataFrame:
    """Write ``df`` in buckets of its column ``chunk``, each task its own files, and read it back.

    Groups of a chunk, and joins on it, then read these files where they lie.
    """
    spark = df.sparkSession
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"brindle_{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "chunk").sortBy("chunk")
    writer.option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte, so that what is mostly zero stands together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view("<u8")
