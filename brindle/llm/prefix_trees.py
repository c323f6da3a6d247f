"""Removal of passages that stand in an earlier document, by suffix trees of prefix groups.

A suffix is a document from one of its words on; a window is the first ``least``
words of a suffix.  A deep node of the suffix tree stands for words, ``least``
or more, that several suffixes begin with.  Three steps find the deep nodes:

1. Only suffixes that begin a maximal repeat are put into trees: their window
   stands in several documents and comes after different words ("left-diverse").
   Chunks of documents hand in codes of their windows and of the words before
   them, and get two bits back for each.  Any match can be followed to the left
   up to such a window, so no match is lost; a suffix is cut where the next one
   begins.
2. Variable-length prefixes split these suffixes into groups that fit into
   memory: a prefix with too much text below it is made longer.
3. Each group gets its suffix tree over the words themselves.  The deepest node
   above a suffix that also has a document with a smaller id tells how many
   words of the suffix go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.chunks import from_planes, planes, stored_by_chunk, with_chunk
from brindle.llm.common import empty_if_null, mixed, prefix_sums, range_hash
from brindle.session import scratch_path

LEAST = 13
#: Text of a chunk of documents.
CHUNK_TEXT = 8 << 20
#: Windows whose codes meet in one task.
CODES = 1 << 20
#: Text of suffixes under one prefix, and of the groups that a task sorts.
GROUP_TEXT = 16 << 20
#: One window in so many begins a suffix whatever stands before it, which bounds the length of suffixes.
EVERY = 64
#: Bytes hashed at once; a longer word is hashed by itself.
PIECE = 1 << 18
#: Bytes of the code of the word before a window, beyond those that number the words of the corpus.
SPARE_BITS = 13

LAST = (1 << 63) - 1


def prefix_lengths(least: int) -> Iterator[int]:
    """Words of the prefixes that groups are formed by; below ``least`` no node matters, beyond each one does."""
    return chain((p for p in (1, 2, 4, 8) if p < least), count(least))


# --- words and windows of a chunk ---


@dataclass
class Words:
    """Words of the documents of a chunk, joined by one space each."""

    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    #: Words before each document, and behind the last.
    before: np.ndarray


def words_of_chunk(texts: Iterable[bytes]) -> Words:
    parts = [b" ".join(t.split()) for t in texts]  # bytes split at 0x20 and 0x09 to 0x0D
    text = b"".join(p + b" " if p else b"" for p in parts)
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    reach = np.cumsum([0, *[len(p) + 1 if p else 0 for p in parts]])
    return Words(text, starts, ends, np.searchsorted(ends, reach))


def word_codes(words: Words) -> np.ndarray:
    """A 64-bit hash of every word."""
    raw = np.frombuffer(words.text, np.uint8)
    out = np.empty(len(words.ends), np.uint64)
    low = 0
    while low < len(out):
        high = max(low + 1, int(np.searchsorted(words.ends, words.starts[low] + PIECE)))
        a, b = int(words.starts[low]), int(words.ends[high - 1])
        if b - a > PIECE:
            out[low] = int.from_bytes(hashlib.blake2b(words.text[a:b], digest_size=8).digest(), "little")
        else:
            out[low:high] = range_hash(prefix_sums(raw[a:b]), words.starts[low:high] - a, words.ends[low:high] - a)
        low = high
    return out


@dataclass
class Windows:
    """Windows of a chunk: document, first word, code, code of the word before."""

    doc: np.ndarray
    word: np.ndarray
    code: np.ndarray
    left: np.ndarray


def windows_of(words: Words, did: np.ndarray, least: int) -> Windows:
    n = np.diff(words.before)
    counts = np.maximum(n - least + 1, 0)
    doc = np.repeat(np.arange(len(n)), counts)
    word = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + words.before[:-1][doc]
    h = word_codes(words)
    total = len(h) - least + 1
    if total <= 0:
        none = np.empty(0, np.uint64)
        return Windows(doc, word, none, none)
    code = np.zeros(total, np.uint64)
    for j in range(least):
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[j : j + total]
        code ^= code >> np.uint64(29)
    left = h[np.maximum(word - 1, 0)]
    first = word == words.before[:-1][doc]
    left[first] = mixed(did[doc[first]].astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    return Windows(doc, word, mixed(code[word]), mixed(left))


class Codes:
    """How many bits of the codes are handed in: enough for the words of the corpus, whatever their number."""

    def __init__(self, total: int, size: int):
        self.bits = min(max(total.bit_length() + 12, 33), 63)
        self.left_bytes = min(-(-(total.bit_length() + SPARE_BITS) // 8), 8)
        self.buckets = max(1, -(-total // size))

    def keys(self, code: np.ndarray) -> np.ndarray:
        return code >> np.uint64(64 - self.bits)

    def lefts(self, left: np.ndarray) -> np.ndarray:
        return left >> np.uint64(64 - 8 * self.left_bytes)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """Buckets in the order of the keys."""
        top = keys >> np.uint64(self.bits - 32)
        return ((top * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64) if self.buckets < 1 << 31 else top.astype(np.int64)


def runs_of(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def handed_in(codes: Codes, windows: Windows, did: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed codes) of the different windows of a chunk, in the order of their keys."""
    if not len(windows.code):
        return
    keys = codes.keys(windows.code)
    order = np.argsort(keys)
    keys = keys[order]
    run = runs_of(keys)
    flags = np.zeros(len(run), np.uint8)
    lefts = codes.lefts(windows.left)[order]
    low = np.minimum.reduceat(lefts, run)
    flags |= (low != np.maximum.reduceat(lefts, run)).astype(np.uint8) << 1
    ids = did[windows.doc][order]
    flags |= np.minimum.reduceat(ids, run) != np.maximum.reduceat(ids, run)
    keys = keys[run]
    bucket = codes.bucket(keys)
    edges = [*runs_of(bucket).tolist(), len(bucket)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        steps = np.diff(keys[a:b], prepend=np.uint64(0))
        yield int(bucket[a]), planes(steps, 8) + planes(low[a:b], codes.left_bytes) + flags[a:b].tobytes()


def answered(codes: Codes, blobs: list[bytes]) -> list[bytes]:
    """For the packed codes of every chunk: which windows stand in several documents, and which of them begin suffixes."""
    width = 9 + codes.left_bytes
    sizes = [len(b) // width for b in blobs]
    keys = np.concatenate([np.cumsum(from_planes(b, n, 8), dtype=np.uint64) for b, n in zip(blobs, sizes, strict=True)])
    lefts = np.concatenate([from_planes(b, n, codes.left_bytes, 8 * n) for b, n in zip(blobs, sizes, strict=True)])
    flags = np.concatenate([np.frombuffer(b, np.uint8, n, (width - 1) * n) for b, n in zip(blobs, sizes, strict=True)])
    order = np.argsort(keys)
    run = runs_of(keys[order])
    lefts, any_flag = lefts[order], np.bitwise_or.reduceat(flags[order], run)
    lengths = np.diff(np.append(run, len(order)))
    repeated = (lengths > 1) | ((any_flag & 1) > 0)
    diverse = (np.minimum.reduceat(lefts, run) != np.maximum.reduceat(lefts, run)) | ((any_flag & 2) > 0)
    begins = repeated & (diverse | (keys[order][run] % np.uint64(EVERY) == 0))
    back = np.empty((2, len(order)), bool)
    back[:, order] = np.repeat(np.stack([repeated, begins]), lengths, axis=1)
    ends = np.cumsum(sizes)
    return [np.packbits(back[:, e - n : e], axis=1).tobytes() for n, e in zip(sizes, ends, strict=True)]


def marks_of(codes: Codes, windows: Windows, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per window of the chunk: stands in several documents; begins a suffix."""
    if not len(windows.code):
        return np.empty(0, bool), np.empty(0, bool)
    keys = codes.keys(windows.code)
    order = np.argsort(keys)
    run = runs_of(keys[order])
    bucket = codes.bucket(keys[order][run])
    edges = [*runs_of(bucket).tolist(), len(bucket)]
    marks = [
        np.unpackbits(np.frombuffer(answers[int(bucket[a])], np.uint8).reshape(2, -1), axis=1, count=b - a)
        for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]
    out = np.empty((2, len(order)), bool)
    out[:, order] = np.repeat(np.concatenate(marks, axis=1).astype(bool), np.diff(np.append(run, len(order))), axis=1)
    return out[0], out[1]


@dataclass
class Suffixes:
    """Suffixes of a chunk that go into trees; equal ones share a number, in the order of their bytes."""

    word: np.ndarray
    did: np.ndarray
    number: np.ndarray
    bodies: list[bytes]
    #: Of each number: smallest document, and words.
    first: np.ndarray
    length: np.ndarray


def suffixes_of(codes: Codes, words: Words, did: np.ndarray, answers: dict[int, bytes], least: int) -> Suffixes:
    windows = windows_of(words, did, least)
    repeated, begins = marks_of(codes, windows, answers)
    at = np.flatnonzero(begins)
    # Last window of the suffix: before the next suffix, before a window of one document only, or the document's last.
    stop = begins | ~repeated
    if len(stop):
        stop |= windows.word == words.before[:-1][windows.doc]
    stops = np.append(np.flatnonzero(stop), len(stop))
    end = stops[np.searchsorted(stops, at, side="right")] - 1
    low, high = words.starts[windows.word[at]], words.ends[windows.word[end] + least - 1] + 1
    bodies = [words.text[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    different = sorted(set(bodies))
    numbers = {b: i for i, b in enumerate(different)}
    number = np.fromiter(map(numbers.__getitem__, bodies), np.int64, len(bodies))
    ids = did[windows.doc[at]]
    first = np.full(len(different), LAST)
    np.minimum.at(first, number, ids)
    length = np.zeros(len(different), np.int64)
    length[number] = end - at + least
    return Suffixes(windows.word[at], ids, number, different, first, length)


# --- suffix trees ---


def common_words(bodies: list[bytes]) -> np.ndarray:
    """Words that each of these sorted strings has in common with the one before; every word ends with a space."""
    n = len(bodies)
    sizes = np.fromiter(map(len, bodies), np.int64, n)
    raw = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8)
    at = np.cumsum(sizes) - sizes
    shared = np.zeros(n, np.int64)
    live, done = np.arange(1, n), 0
    most = np.minimum(sizes[1:], sizes[:-1]) if n > 1 else np.empty(0, np.int64)
    while len(live):
        a, b = (raw[at[live - k][:, None] + done + np.arange(8)] for k in (0, 1))
        same = np.cumprod(a == b, axis=1).sum(axis=1)
        same = np.minimum(same, most[live - 1] - done)
        shared[live] += same
        live = live[(same == 8) & (most[live - 1] > done + 8)]
        done += 8
    spaces = np.concatenate([[0], np.cumsum(raw == 32)])
    return spaces[at + shared] - spaces[at]


class Subtree:
    """Deep nodes of the suffix tree over sorted strings: depth in words, parent, smallest document below."""

    def __init__(self, common: np.ndarray, ids: np.ndarray, least: int):
        self.depth: list[int] = [0]
        self.parent: list[int] = [0]
        self.first: list[int] = [LAST]
        self.leaf: list[int] = []
        open_ = [0]
        depths = np.where(common >= least, common, 0).tolist()
        ahead = [*depths[1:], 0]
        for i, (behind, next_, one) in enumerate(zip(depths, ahead, ids.tolist(), strict=True)):
            if i:
                self._close(open_, behind)
            if next_ > self.depth[open_[-1]]:
                self._open(open_, next_)
            self.leaf.append(open_[-1])
            self.first[open_[-1]] = min(self.first[open_[-1]], one)
        self._close(open_, 0)

    def _open(self, open_: list[int], depth: int) -> None:
        self.depth.append(depth)
        self.parent.append(open_[-1])
        self.first.append(LAST)
        open_.append(len(self.depth) - 1)

    def _close(self, open_: list[int], depth: int) -> None:
        """Nodes deeper than ``depth`` are complete; one of just this depth goes between, if there is none."""
        while self.depth[open_[-1]] > depth:
            node = open_.pop()
            if self.depth[open_[-1]] < depth:
                self._open(open_, depth)
            self.parent[node] = open_[-1]
            self.first[open_[-1]] = min(self.first[open_[-1]], self.first[node])

    def earlier_words(self, ids: np.ndarray) -> list[int]:
        """Per suffix: depth of the deepest node above it that has a document with a smaller id."""
        out = []
        for node, one in zip(self.leaf, ids.tolist(), strict=True):
            while node and self.first[node] >= one:
                node = self.parent[node]
            out.append(self.depth[node])
        return out


def earlier_words(bodies: list[bytes], ids: np.ndarray, least: int) -> np.ndarray:
    """Per string: words at its front that a string of a smaller document has as well, if ``least`` or more."""
    order = sorted(range(len(bodies)), key=bodies.__getitem__)
    ids = ids[order]
    tree = Subtree(common_words([bodies[i] for i in order]), ids, least)
    out = np.empty(len(order), np.int64)
    out[order] = tree.earlier_words(ids)
    return out


# --- the job ---


def _arrays(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy(zero_copy_only=False) if table.num_rows else np.empty(0, np.int64)


def _texts(table: pa.Table) -> list[bytes]:
    return table.column("text").cast(pa.large_binary()).to_pylist()


ANSWER = "chunk long, bucket long, blob binary"
LENGTHS = "chunk long, bucket long, blob binary"
SUFFIX = "chunk long, number long, did long, body string"


class PrefixTrees:
    """The steps for one corpus; each is a function over a group or a partition."""

    def __init__(self, least: int, codes: Codes):
        self.least, self.codes = least, codes

    def hand_in(self, docs: pa.Table) -> pa.Table:
        chunk, did = docs.column("chunk")[0].as_py(), _arrays(docs, "did")
        words = words_of_chunk(_texts(docs))
        rows = list(handed_in(self.codes, windows_of(words, did, self.least), did))
        return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    def answer(self, rows: pa.Table) -> pa.Table:
        return rows.set_column(2, "blob", pa.array(answered(self.codes, rows.column("blob").to_pylist()), pa.binary()))

    def _suffixes(self, docs: pa.Table, answers: pa.Table) -> tuple[Words, Suffixes]:
        words, did = words_of_chunk(_texts(docs)), _arrays(docs, "did")
        found = dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        return words, suffixes_of(self.codes, words, did, found, self.least)

    def suffixes(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "number": pa.array([], pa.int64()), "did": pa.array([], pa.int64()), "body": pa.array([], pa.string())})
        _, found = self._suffixes(docs, answers)
        n = len(found.bodies)
        body = pa.array(found.bodies, pa.binary()).cast(pa.string())
        return pa.table({"chunk": np.full(n, docs.column("chunk")[0].as_py()), "number": np.arange(n), "did": found.first, "body": body})

    def trees(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed numbers and words per chunk, from the trees of all groups of a partition."""
        table = list(batches)
        if not table:
            return
        table = pa.Table.from_batches(table)
        words = earlier_words(table.column("body").cast(pa.large_binary()).to_pylist(), _arrays(table, "did"), self.least)
        words = np.maximum(words, _arrays(table, "known"))
        chunk, number = _arrays(table, "chunk"), _arrays(table, "number")
        hit = np.flatnonzero(words >= self.least)
        hit = hit[np.argsort(chunk[hit], kind="stable")]
        if not len(hit):
            return
        edges = [*runs_of(chunk[hit]).tolist(), len(hit)]
        parts = [hit[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        blobs = [np.column_stack([number[p], words[p]]).astype("<u4").tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[[p[0] for p in parts]]), pa.array([-1] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "bucket", "blob"])

    def removal(self, schema: T.StructType, keep_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.string())
            if not docs.num_rows:
                return pa.table([docs.column("doc_id"), *[pa.array([], k) for k in kinds]], names=schema.names)
            is_answer = np.asarray(_arrays(replies, "bucket") >= 0, bool)
            words, found = self._suffixes(docs, replies.filter(pa.array(is_answer)))
            known = np.zeros(len(found.bodies), np.int64)
            for blob in replies.filter(pa.array(~is_answer)).column("blob").to_pylist():
                pairs = np.frombuffer(blob, "<u4").reshape(-1, 2)
                known[pairs[:, 0]] = pairs[:, 1]
            # A copy in a later document of the same chunk goes whole.
            gone = np.where(found.did > found.first[found.number], found.length[found.number], known[found.number])
            change = np.zeros(len(words.ends) + 1, np.int64)
            some = gone > 0
            np.add.at(change, found.word[some], 1)
            np.add.at(change, found.word[some] + gone[some], -1)
            removed = np.cumsum(change[:-1]) > 0
            rows = [_kept(words, removed, a, b, keep_text) for a, b in zip(words.before[:-1].tolist(), words.before[1:].tolist(), strict=True)]
            return pa.table([docs.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=schema.names)

        return run


def _kept(words: Words, removed: np.ndarray, a: int, b: int, keep_text: bool) -> tuple:
    """Of the document with words a to b: words, starts and ends of the removed runs, digest and text of what stays."""
    gone = np.concatenate([[False], removed[a:b], [False]])
    starts, ends = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(gone[:-1] & ~gone[1:])
    parts = []
    for low, high in zip([0, *ends.tolist()], [*starts.tolist(), b - a], strict=True):
        if high > low:
            parts.append(words.text[words.starts[a + low] : words.ends[a + high - 1]])
    kept = b" ".join(parts)
    return b - a, starts, ends, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None


def routed(suffixes: DataFrame, least: int, group_text: int) -> DataFrame:
    """``suffixes`` with ``route``, the hash of the shortest prefix with at most ``group_text`` bytes below it,
    and ``known``, the words of the longest prefix beyond which the groups part that an earlier document has too.

    The prefixes with more text below them are at most as many as the whole text has groups of that size: that
    bounds what is broadcast.  Suffixes that are equal throughout need no tree and are not parted further.
    """
    spark, folder = suffixes.sparkSession, scratch_path(suffixes.sparkSession, "prefixes")
    size = (F.octet_length("body") + 32).cast("long")
    out = suffixes.withColumn("route", F.lit(None).cast("long")).withColumn("known", F.lit(0).cast("long"))
    live = suffixes
    for p in prefix_lengths(least):
        prefix = F.substring_index("body", " ", p)
        below = live.groupBy(F.xxhash64(prefix).alias("prefix")).agg(F.sum(size).alias("size"), F.min("did").alias("first"), F.min("body").alias("a"), F.max("body").alias("b"))
        below.filter((F.col("size") > group_text) & (F.col("a") != F.col("b"))).select("prefix", "first").write.parquet(f"{folder}/{p}")
        large = F.broadcast(spark.read.parquet(f"{folder}/{p}"))
        here = F.xxhash64(prefix)
        if large.isEmpty():
            return out.withColumn("route", F.coalesce("route", here))
        out = out.withColumn("prefix", here).join(large, "prefix", "left")
        out = out.withColumn("route", F.coalesce("route", F.when(F.col("first").isNull(), F.col("prefix"))))
        if p >= least:
            out = out.withColumn("known", F.when(F.col("first") < F.col("did"), F.lit(p).cast("long")).otherwise(F.col("known")))
        out = out.drop("prefix", "first")
        live = live.withColumn("prefix", here).join(large.select("prefix"), "prefix", "left_semi").drop("prefix")
    raise AssertionError


def dedup_passages(docs: DataFrame, least: int = LEAST, *, keep_text: bool = True, chunk_text: int = CHUNK_TEXT, codes: int = CODES, group_text: int = GROUP_TEXT) -> DataFrame:
    """One row per document: doc_id, n_words, starts and ends of the removed runs of words, kept_sha256, kept.

    A word goes if it is covered by ``least`` consecutive words of its document
    that also begin in a document with a smaller doc_id.  ``kept`` is what stays,
    joined by one space (null with ``keep_text=False``).

    Nulls: a null text has no words; a null doc_id counts as larger than any
    other, so such rows remove nothing from each other.  Rows that share a
    doc_id remove nothing from each other either.  A text of fewer than
    ``least`` words stays whole, an empty table gives an empty one, further
    columns are not read.  doc_id must be an integer.

    Windows are told apart by codes whose length grows with the corpus; a code
    that is too short puts more suffixes into trees, which compare the words.
    That a window's different left words all have one code, which could lose a
    match, is to be expected 2^-13 times in a corpus of any size.  A text is
    held whole, with about twenty times its bytes.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer")
    if least < 2:
        raise ValueError("least must be 2 or more")
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "passages")
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), empty_if_null("text").alias("text"))
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    job = PrefixTrees(least, Codes(total // 2 + 1, 2 * codes))
    chunks = stored_by_chunk(with_chunk(base, "text", chunk_text), -(-total // (2 * chunk_text)) or 1, "passages")
    by_chunk = chunks.groupBy("chunk")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    handed = by_chunk.applyInArrow(lambda docs: job.hand_in(docs), ANSWER).repartition(job.codes.buckets, "bucket")
    answers = written(handed.groupBy("bucket").applyInArrow(lambda rows: job.answer(rows), ANSWER), "answers")
    suffixes = written(by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(lambda docs, found: job.suffixes(docs, found), SUFFIX), "suffixes")
    text = suffixes.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    groups = routed(suffixes, least, group_text).repartition(max(1, -(-text // group_text)), "route")
    lengths = written(groups.mapInArrow(job.trees, LENGTHS), "lengths")
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_words", T.LongType())]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends")]
        + [T.StructField(c, T.StringType()) for c in ("kept_sha256", "kept")]
    )
    replies = answers.unionByName(lengths).groupBy("chunk")
    return by_chunk.cogroup(replies).applyInArrow(job.removal(schema, keep_text), schema)
