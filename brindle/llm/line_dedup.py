"""Repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import POWERS, chunked, content_key, mixed, prefix_sums, range_hash, utf8_buffers, words_of
from brindle.session import scratch_path

#: Words that a run of lines must have to be removed as a repetition; any such run has a common fingerprint.
LEAST_WORDS = 25
CHUNK = 1 << 20

_KEY = mixed(np.arange(7, 11, dtype=np.uint64)) | np.uint64(1)


def line_facts(raw: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, hash and words of the lines of one text that have words; blanks around a line do not count."""
    numbers, starts, ends, words, at = [], [], [], [], 0
    for i, line in enumerate(data.split(b"\n")):
        n = len(words_of(line))
        if n:
            start = at + len(line) - len(line.lstrip())
            numbers.append(i)
            starts.append(start)
            ends.append(start + len(line.strip()))
            words.append(n)
        at += len(line) + 1
    hashes = range_hash(prefix_sums(raw), np.array(starts, np.int64), np.array(ends, np.int64)) if numbers else np.empty(0, np.uint64)
    return np.array(numbers, np.int64), hashes, np.array(words, np.int64)


def windows(words: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the shortest runs of ``least`` words that start, or that end, at each line.

    Every line of a run with ``least`` words lies in such a window inside the run.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    start = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least)
    forward = np.column_stack([start, end])[end <= n]
    first = np.searchsorted(total, total[1:] - least, side="right") - 1
    backward = np.column_stack([first, start + 1])[total[1:] >= least]
    return np.unique(np.concatenate([forward, backward]), axis=0)


def fingerprints(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, window) for every window: the smallest line hash in it, where it stands, and what surrounds it there.

    Windows with the same lines select the same line, so two texts that share
    a run share its fingerprints.
    """
    found = windows(words, least)
    if not len(found):
        return np.empty((0, 2), np.uint64), found
    place = mixed(hashes)
    sums = prefix_sums_of(hashes)
    least_at = np.array([s + int(np.argmin(place[s:e])) for s, e in found.tolist()], np.int64)
    content = range_hash(sums, found[:, 0], found[:, 1])
    around = mixed(content * _KEY[0] + (least_at - found[:, 0]).astype(np.uint64) * _KEY[1])
    return np.column_stack([hashes[least_at], around]), found


def prefix_sums_of(hashes: np.ndarray) -> np.ndarray:
    """Sums for :func:`range_hash` over line hashes in place of bytes."""
    up, _ = POWERS.upto(len(hashes) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes) * up[:-1], dtype=np.uint64)])


def document_lines(docs: DataFrame, least: int) -> DataFrame:
    """(row_key, doc_id, numbers, hashes, marks): the lines of every text and its fingerprints.

    A mark is (line hash, surroundings, first line, end line) of a window.
    """
    mark = T.StructType([T.StructField(c, T.LongType()) for c in ("line", "around")] + [T.StructField(c, T.IntegerType()) for c in ("first", "end")])
    schema = T.StructType(
        [T.StructField("row_key", T.LongType()), docs.schema["doc_id"], T.StructField("n_lines", T.IntegerType())]
        + [T.StructField("numbers", T.ArrayType(T.IntegerType())), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType()))]
        + [T.StructField("marks", T.ArrayType(mark))]
    )
    mark_type = pa.struct([("line", pa.int64()), ("around", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", CHUNK):
            raw, at = utf8_buffers(batch.column("text"))
            columns: tuple[list, ...] = ([], [], [], [], [])
            for low, high in zip(at.tolist(), at[1:].tolist(), strict=False):
                data = raw[low:high].tobytes()
                numbers, hashes, words = line_facts(raw[low:high], data)
                keys, found = fingerprints(hashes, words, least)
                signed = keys.view(np.int64)
                fields = (signed[:, 0], signed[:, 1], found[:, 0].astype(np.int32), found[:, 1].astype(np.int32))
                marks = pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(mark_type))
                row = (data.count(b"\n") + 1 if data else 0, numbers.astype(np.int32), hashes.view(np.int64), words.astype(np.int32), marks)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            marks = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(m) for m in columns[4]])]).astype(np.int32), pa.concat_arrays(columns[4]))
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), *arrays, marks], schema.names)

    return docs.select(content_key("doc_id", "text").alias("row_key"), "doc_id", "text").mapInArrow(run, schema)


def extended(own: np.ndarray, other: np.ndarray, first: np.ndarray, end: np.ndarray, there: np.ndarray) -> list[tuple[int, int]]:
    """Maximal equal runs around matched windows [first, end) of ``own`` that start at ``there`` in ``other``.

    Windows on one diagonal that touch or overlap are one match; what is between
    separate ones is compared when the match is extended.
    """
    runs: list[tuple[int, int]] = []
    order = np.lexsort((first, there - first))
    reach: dict[int, int] = {}
    for k in order.tolist():
        low, high, shift = int(first[k]), int(end[k]), int(there[k] - first[k])
        if reach.get(shift, -1) >= high:
            continue
        while low > 0 and low + shift > 0 and own[low - 1] == other[low + shift - 1]:
            low -= 1
        while high < len(own) and high + shift < len(other) and own[high] == other[high + shift]:
            high += 1
        reach[shift] = high
        runs.append((low, high))
    return runs


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def repeated_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, row_key, n_lines, runs as (first line, end line, words).

    A run of lines with at least ``least`` words that also stands earlier, in a
    document with a smaller doc_id or further up in the same one, is repeated;
    the first copy is not.  Lines are equal up to blanks around them; lines
    without words are passed over and go with a run that surrounds them.  Runs
    are judged on the input, not on what is left of it.

    Fingerprints that stand at several places are joined with their first
    place, never with one another, and the match is extended both ways from
    there.  First places are a minimum, reduced in each task before the shuffle,
    so a line that a third of all documents share sends one row per task.

    Nulls: a null text has no lines; a null doc_id sorts after all others, rows
    with the same doc_id by the hash of their text.  Rows that repeat as a whole
    are one document.  Further columns are not read.
    """
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "lines")
    document_lines(docs, least).write.parquet(f"{folder}/lines")
    lines = spark.read.parquet(f"{folder}/lines")
    marks = lines.select("row_key", "doc_id", F.explode("marks").alias("m")).select("row_key", "doc_id", "m.*")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "first")
    heads = marks.groupBy("line", "around").agg(F.min(place).alias("head"), F.count("*").alias("n")).filter("n > 1")
    later = marks.join(heads.drop("n"), ["line", "around"]).filter(~((F.col("row_key") == F.col("head.row_key")) & (F.col("first") == F.col("head.first"))))
    match = F.struct("first", "end", F.col("head.first").alias("there"))
    pairs = later.groupBy("row_key", F.col("head.row_key").alias("head_key")).agg(F.collect_set(match).alias("matches"))
    sequences = lines.select("row_key", "hashes").dropDuplicates(["row_key"])
    heads_of = sequences.select(F.col("row_key").alias("head_key"), F.col("hashes").alias("other"))
    both = pairs.join(sequences, "row_key").join(heads_of, "head_key").select("row_key", "hashes", "other", "matches")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, firsts, ends = [], [], []
            for i in range(batch.num_rows):
                own, other = (batch.column(c)[i].values.to_numpy() for c in ("hashes", "other"))
                matches = batch.column("matches")[i].values
                first, end, there = (matches.field(c).to_numpy() for c in ("first", "end", "there"))
                for low, high in united(extended(own, other, first, end, there)):
                    keys.append(batch.column("row_key")[i].as_py())
                    firsts.append(low)
                    ends.append(high)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32())], ["row_key", "first", "end"])

    found = both.mapInArrow(run, "row_key long, first int, end int")
    found = found.groupBy("row_key").agg(F.collect_set(F.struct("first", "end")).alias("found"))
    return _numbered(lines.select("row_key", "doc_id", "n_lines", "numbers", "words").join(found, "row_key", "left"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Found runs united, with the numbers of their lines in the text."""
    schema = T.StructType(
        [T.StructField("row_key", T.LongType()), rows.schema["doc_id"], rows.schema["n_lines"]]
        + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends", "run_words")]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                found = batch.column("found")[i].as_py() or []
                runs = united([(r["first"], r["end"]) for r in found])
                numbers, words = ((batch.column(c)[i].values.to_numpy() for c in ("numbers", "words")) if runs else ((), ()))
                columns[0].append([int(numbers[low]) for low, _ in runs])
                columns[1].append([int(numbers[high - 1]) + 1 for _, high in runs])
                columns[2].append([int(words[low:high].sum()) for low, high in runs])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_key", "doc_id", "n_lines")), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], schema.names)

    return rows.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without its repeated runs of lines; n_lines, n_removed and n_runs are added.

    The other columns stay.  A text is changed only where a run is removed; a
    document of which nothing is left has an empty text.
    """
    runs = repeated_runs(docs, least).select(F.col("row_key").alias("__row"), "n_lines", F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))
    runs = runs.dropDuplicates(["__row"])
    size = F.aggregate(F.zip_with("__ends", "__starts", lambda e, s: e - s), F.lit(0), lambda a, b: a + b)
    keyed = docs.drop("n_lines", "n_removed", "n_runs").withColumn("__row", content_key("doc_id", "text")).join(runs, "__row")
    kept = F.filter(
        F.split("text", "\n"), lambda _, i: ~F.exists(F.arrays_zip("__starts", "__ends"), lambda r: (r["__starts"] <= i) & (i < r["__ends"]))
    )
    text = F.when(F.size("__starts") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return keyed.withColumns({"text": text, "n_removed": size, "n_runs": F.size("__starts")}).drop("__row", "__starts", "__ends")
