"""Sums of arrays over all tasks: packed partial results, merged in levels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial results that one task merges; the last level has one of each block.
FAN_IN = 32

Batches = Iterable[pa.RecordBatch]
Blocks = dict[int, np.ndarray]
PARTIAL = "part long, block long, cells binary"


def pack(x: np.ndarray) -> bytes:
    """Integers or doubles, whatever the shape."""
    return (b"i" if x.dtype.kind == "i" else b"f") + x.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64 if blob[:1] == b"i" else np.float64, offset=1)


def _rows(part: int, blocks: Blocks) -> Iterator[pa.RecordBatch]:
    """One batch per block: a block may be large."""
    for block, x in sorted(blocks.items()):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([pack(x)], pa.binary())], ["part", "block", "cells"])


def merged_blocks(
    rows: DataFrame, partial: Callable[[Batches], Blocks], add: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add, tasks: int | None = None
) -> DataFrame:
    """(block, cells): the blocks that ``partial`` makes of each task's batches, those of one number added up.

    A level merges ``FAN_IN`` parts of a block in one task, so behind the first
    level the shuffle shrinks by that factor each time, however many tasks there
    were.  ``tasks`` is the number of partitions of ``rows``.
    """
    if tasks is None:
        tasks = rows.rdd.getNumPartitions()

    def first(batches: Batches) -> Iterator[pa.RecordBatch]:
        yield from _rows(TaskContext.get().partitionId(), partial(batches))

    def merge(batches: Batches) -> Iterator[pa.RecordBatch]:
        found: dict[int, Blocks] = {}
        for batch in batches:
            for part, block, cells in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "cells")), strict=True):
                blocks, x = found.setdefault(part, {}), unpack(cells)
                blocks[block] = add(blocks[block], x) if block in blocks else x
        for part, blocks in sorted(found.items()):
            yield from _rows(part, blocks)

    out = rows.mapInArrow(first, PARTIAL)
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        out = out.withColumn("part", F.pmod("part", F.lit(tasks))).repartition("part", "block").mapInArrow(merge, PARTIAL)
    return out.select("block", "cells")


def summed(rows: DataFrame, partial: Callable[[Batches], np.ndarray | None], add: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add, tasks: int | None = None) -> np.ndarray | None:
    """Sum of one small array per task; the driver adds the last ``FAN_IN``. None if no task has one."""

    def one(batches: Batches) -> Blocks:
        x = partial(batches)
        return {} if x is None else {0: x}

    if tasks is None:
        tasks = rows.rdd.getNumPartitions()
    if tasks <= FAN_IN:

        def only(batches: Batches) -> Iterator[pa.RecordBatch]:
            yield from _rows(TaskContext.get().partitionId(), one(batches))

        parts = [r.cells for r in sorted(rows.mapInArrow(only, PARTIAL).collect())]
    else:
        parts = [r.cells for r in merged_blocks(rows, one, add, tasks).collect()]
    total = None
    for x in map(unpack, parts):
        total = x if total is None else add(total, x)
    return total
