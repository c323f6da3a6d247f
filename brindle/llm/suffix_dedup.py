"""Removal of byte strings that stand earlier in the corpus, by longest-previous-factor arrays.

A window is a string of ``least`` bytes.  Windows are grouped by their anchor
(:mod:`brindle.llm.anchors`): equal windows have the same gram at their anchor.
Where the bytes around two anchors are equal, all their windows are, and the
later ones are removed as a whole.  The first anchors that share a gram but not
all bytes around it meet in a bucket.  There the suffixes at their window
starts are sorted, and the previous and next smaller positions in suffix order
give the longest factor that stands earlier; ``least`` bytes of it are enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.anchors import anchors_of
from brindle.llm.common import chunked, empty_if_null, prefix_sums, range_hash, utf8_buffers
from brindle.session import scratch_path

LEAST = 100
CHUNK = 1 << 20
#: Text of which a task compares the anchors before it passes them on.
GATHERED = 16 << 20
#: Text per bucket of anchors and per bucket of documents.
BUCKET_TEXT = 8 << 20
#: Different surroundings of one gram that are sorted together; beyond, their windows are dealt out singly.
HOT = 1 << 16

LAST = (1 << 63) - 1

#: Packed rows: what is known of an anchor, of a removed span, of a candidate, of a string to sort.
ANCHOR = {"g": "<u8", "c": "<u8", "did": "<i8", "dk": "<u4", "lo": "<u4", "n": "u1"}
SPAN = {"did": "<i8", "dk": "<u4", "lo": "<u4", "hi": "<u4"}
CANDIDATE = {"g": "<u8", "did": "<i8", "dk": "<u4", "lo": "<u4", "n": "u1", "hot": "u1"}
STRING = {"did": "<i8", "dk": "<u4", "lo": "<u4", "n": "u1"}

Columns = dict[str, np.ndarray]


def pack(rows: Columns, kinds: dict[str, str]) -> bytes:
    return b"".join(np.ascontiguousarray(rows[c], k).tobytes() for c, k in kinds.items())


def unpack(blobs: list[bytes], kinds: dict[str, str]) -> Columns:
    width = sum(np.dtype(k).itemsize for k in kinds.values())
    parts: dict[str, list[np.ndarray]] = {c: [np.empty(0, k)] for c, k in kinds.items()}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for c, k in kinds.items():
            parts[c].append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
    return {c: np.concatenate(p) for c, p in parts.items()}


def taken(rows: Columns, which: np.ndarray) -> Columns:
    return {c: v[which] for c, v in rows.items()}


def place_order(rows: Columns) -> np.ndarray:
    """Order by document and position."""
    return np.lexsort((rows["lo"], rows["dk"], rows["did"]))


def dealt(kind: str, bucket: np.ndarray, rows: Columns, kinds: dict[str, str]) -> Iterator[tuple[str, int, bytes]]:
    """One packed row (kind, bucket, blob) per bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(b)], strict=True):
        yield kind, int(b[low]), pack(taken(rows, order[low:high]), kinds)


def doc_bucket(rows: Columns, buckets: int) -> np.ndarray:
    mixed = rows["did"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows["dk"].astype(np.uint64)
    return ((mixed >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)


def split_later(rows: Columns, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first row of each key, by document and position, and of those that stand later."""
    by_place = place_order(rows)
    order = by_place[np.lexsort([rows[k][by_place] for k in reversed(keys)])]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        v = rows[k][order]
        new[1:] |= v[1:] != v[:-1]
    head = order[np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(order))))]
    same_place = (rows["did"][order] == rows["did"][head]) & (rows["dk"][order] == rows["dk"][head]) & (rows["lo"][order] == rows["lo"][head])
    return order[new], order[~same_place]


def spans_of(rows: Columns, least: int) -> Columns:
    """The bytes of all windows of an anchor, as united spans."""
    return united({"did": rows["did"], "dk": rows["dk"], "lo": rows["lo"].astype(np.int64), "hi": rows["lo"].astype(np.int64) + rows["n"] + least - 1})


def united(spans: Columns) -> Columns:
    """Spans of each document in order, those that touch or overlap made one."""
    if not len(spans["lo"]):
        return spans
    s = taken(spans, place_order(spans))
    new_doc = np.ones(len(s["lo"]), bool)
    new_doc[1:] = (s["did"][1:] != s["did"][:-1]) | (s["dk"][1:] != s["dk"][:-1])
    # Ends so far within the document: offsets by document keep the running maximum apart.
    doc = np.cumsum(new_doc) - 1
    lo, hi = s["lo"].astype(np.int64), s["hi"].astype(np.int64)
    reach = np.maximum.accumulate(hi + (doc << 33)) - (doc << 33)
    new = new_doc.copy()
    new[1:] |= lo[1:] > reach[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(lo)) - 1
    return {"did": s["did"][head], "dk": s["dk"][head], "lo": lo[head], "hi": reach[tail]}


def suffix_array(raw: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes, and the common prefix with the one before.

    Eight bytes at a time: a round sorts, within the groups that are still equal, by the next word.
    """
    n = len(starts)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    order = np.arange(n)
    lcp = np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)
    live = np.arange(n) if n > 1 else np.empty(0, np.int64)
    for at in range(0, depth, 8):
        if not len(live):
            break
        width = min(8, depth - at)
        word = np.zeros(len(live), np.uint64)
        for k in range(width):
            word = (word << np.uint64(8)) | padded[starts[order[live]] + at + k]
        by = np.lexsort((word, group[live]))
        order[live], word, g = order[live][by], word[by], group[live]
        same_group = np.zeros(len(live), bool)
        same_group[1:] = g[1:] == g[:-1]
        differs = np.zeros(len(live), bool)
        differs[1:] = word[1:] != word[:-1]
        lcp[live[same_group & ~differs]] = at + width
        split = live[same_group & differs]
        if len(split):
            x = word[1:] ^ word[:-1]
            x = x[(same_group & differs)[1:]]
            lead = np.zeros(len(x), np.int64)
            for k in range(1, width):
                lead += (x >> np.uint64(8 * (width - k))) == 0
            lcp[split] = at + lead
        equal = same_group & ~differs
        group[live] = live[np.maximum.accumulate(np.where(equal, 0, np.arange(len(live))))]
        keep = equal.copy()
        keep[:-1] |= equal[1:]
        live = live[keep]
    return order, lcp


def longest_previous_factors(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For suffixes in order: the longest prefix that starts at a smaller position as well.

    The previous and the next smaller position in suffix order are the best
    matches that start earlier.  They are found by jumps over larger
    positions, all suffixes at once; each jump takes the smaller common prefix.
    """
    return np.maximum(_previous_smaller(position, lcp), _previous_smaller(position[::-1], np.append(lcp[1:], 0)[::-1])[::-1])


def _previous_smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    n = len(position)
    jump = np.arange(-1, n - 1)
    common = lcp.copy()
    common[:1] = 0
    open_ = np.flatnonzero(jump >= 0)
    open_ = open_[position[jump[open_]] >= position[open_]]
    while len(open_):
        over = jump[open_]
        common[open_] = np.minimum(common[open_], common[over])
        jump[open_] = jump[over]
        open_ = open_[jump[open_] >= 0]
        open_ = open_[position[jump[open_]] >= position[open_]]
    common[jump < 0] = 0
    return common


def repeated_starts(strings: list[np.ndarray], rows: Columns, least: int) -> Columns:
    """Spans of the windows that stand earlier, among the strings of one bucket.

    ``rows`` has the document, the first window start and the number of windows of each string.
    """
    order = place_order(rows)
    rows, strings = taken(rows, order), [strings[i] for i in order.tolist()]
    raw = np.concatenate(strings)
    base = np.cumsum([0, *[len(s) for s in strings[:-1]]])
    counts = rows["n"].astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    # Strings in place order: the number of a window start is its position; equal places get the same.
    first = np.ones(len(counts), bool)
    first[1:] = (rows["did"][1:] != rows["did"][:-1]) | (rows["dk"][1:] != rows["dk"][:-1]) | (rows["lo"][1:] != rows["lo"][:-1])
    rank = np.cumsum(first)
    position = rank[text].astype(np.int64) * 1024 + step
    suffixes, lcp = suffix_array(raw, base[text] + step, least)
    factor = np.empty(len(text), np.int64)
    factor[suffixes] = longest_previous_factors(position[suffixes], lcp)
    hit = factor >= least
    lo = rows["lo"][text[hit]].astype(np.int64) + step[hit]
    return united({"did": rows["did"][text[hit]], "dk": rows["dk"][text[hit]], "lo": lo, "hi": lo + least})


PACKED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("blob", T.BinaryType())])


def _packed(rows: Iterable[tuple[str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[2])
        if size > 4 << 20:
            yield _batch(part)
            part, size = [], 0
    if part:
        yield _batch(part)


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], PACKED.names)


def _blobs(batches: Iterable[pa.RecordBatch]) -> dict[str, list[bytes]]:
    """All blobs of a partition by kind; a partition is a few buckets, which are of bounded size."""
    out: dict[str, list[bytes]] = {}
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            out.setdefault(kind, []).append(blob)
    return out


class SuffixDedup:
    """The stages for one corpus; each is a function over the batches of a partition."""

    def __init__(self, least: int, buckets: int, hot: int):
        self.least, self.buckets, self.hot = least, buckets, hot

    def anchors(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of a task's texts, dealt by gram; of equal ones only the first, the others as spans."""
        held: list[Columns] = []
        size = 0
        for batch in chunked(batches, "text", CHUNK):
            raw, at = utf8_buffers(batch.column("text"))
            did = batch.column("did").to_numpy(zero_copy_only=False)
            dk = batch.column("dk").to_numpy(zero_copy_only=False)
            # A long text goes in pieces that overlap, so that every window lies in one of them.
            for at_piece in range(0, len(raw), CHUNK) if batch.num_rows == 1 else [0]:
                piece = raw[at_piece : at_piece + CHUNK + self.least - 1] if batch.num_rows == 1 else raw
                ends = np.array([0, len(piece)]) if batch.num_rows == 1 else at
                text, _, low, high, gram, around = anchors_of(piece, ends, self.least)
                held.append({"g": gram, "c": around, "did": did[text], "dk": dk[text], "lo": at_piece + low - ends[text], "n": high - low + 1})
            size += len(raw)
            if size >= GATHERED:
                yield from self._flushed(held)
                held, size = [], 0
        if held:
            yield from self._flushed(held)

    def _flushed(self, held: list[Columns]) -> Iterator[pa.RecordBatch]:
        rows = {c: np.concatenate([h[c] for h in held]).astype(k) for c, k in ANCHOR.items()}
        first, later = split_later(rows, ("g", "c"))
        kept = taken(rows, first)
        spans = spans_of(taken(rows, later), self.least)
        yield from _packed(dealt("anchor", (kept["g"] % np.uint64(self.buckets)).astype(np.int64), kept, ANCHOR))
        yield from _packed(dealt("span", doc_bucket(spans, self.buckets), spans, SPAN))

    def resolved(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal anchors all but the first are spans; first ones that share their gram are candidates."""
        blobs = _blobs(batches)
        rows = unpack(blobs.get("anchor", []), ANCHOR)
        first, later = split_later(rows, ("g", "c"))
        spans = united({c: np.concatenate(v) for c, v in _joined(spans_of(taken(rows, later), self.least), unpack(blobs.get("span", []), SPAN)).items()})
        yield from _packed(dealt("span", doc_bucket(spans, self.buckets), spans, SPAN))
        heads = taken(rows, first)
        _, inverse, counts = np.unique(heads["g"], return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1
        found = taken(heads, shared) | {"hot": (counts[inverse] > self.hot)[shared]}
        yield from _packed(dealt("candidate", doc_bucket(found, self.buckets), found, CANDIDATE))

    def by_document(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document that has spans or candidates: did, dk, spans, candidates."""
        blobs = _blobs(batches)
        spans, found = united(unpack(blobs.get("span", []), SPAN)), unpack(blobs.get("candidate", []), CANDIDATE)
        found = taken(found, place_order(found))
        docs = {(int(a), int(b)) for a, b in zip(spans["did"], spans["dk"], strict=True)} | {(int(a), int(b)) for a, b in zip(found["did"], found["dk"], strict=True)}
        parts = [_slices(spans), _slices(found)]
        rows = []
        for did, dk in sorted(docs):
            s, c = (p.get((did, dk), slice(0, 0)) for p in parts)
            flat = np.column_stack([spans["lo"][s], spans["hi"][s]]).astype("<u4").tobytes()
            rows.append((did, dk, flat, pack(taken(found, c), CANDIDATE)))
            if len(rows) == 5000:
                yield _document_batch(rows)
                rows = []
        if rows:
            yield _document_batch(rows)

    def strings(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes around every candidate, dealt by gram; those of hot grams window by window, dealt by content."""
        for batch in chunked(batches, "text", GATHERED):
            raw, at = utf8_buffers(batch.column("text"))
            out: dict[int, list[tuple[Columns, bytes]]] = {}
            hot: list[Columns] = []
            for i, blob in enumerate(batch.column("candidates").to_pylist()):
                found = unpack([blob], CANDIDATE)
                text = raw[at[i] : at[i + 1]]
                for k in range(len(found["lo"])):
                    row = {c: v[k : k + 1] for c, v in found.items()}
                    low, n = int(row["lo"][0]), int(row["n"][0])
                    if row["hot"][0]:
                        starts = np.arange(low, low + n)
                        one = text[low : low + n + self.least - 1]
                        keys = range_hash(prefix_sums(one), starts - low, starts - low + self.least)
                        hot.append({"w": keys, "did": np.repeat(row["did"], n), "dk": np.repeat(row["dk"], n), "lo": starts, "at": at[i] + starts})
                    else:
                        out.setdefault(int(row["g"][0] % np.uint64(self.buckets)), []).append((row, text[low : low + n + self.least - 1].tobytes()))
            if hot:
                rows = {c: np.concatenate([h[c] for h in hot]) for c in hot[0]}
                first, later = split_later(rows, ("w",))
                spans = united({"did": rows["did"][later], "dk": rows["dk"][later], "lo": rows["lo"][later], "hi": rows["lo"][later] + self.least})
                yield from _packed(dealt("span", doc_bucket(spans, self.buckets), spans, SPAN))
                for k in first.tolist():
                    row = {c: rows[c][k : k + 1] for c in ("did", "dk", "lo")} | {"n": np.ones(1, np.uint8)}
                    out.setdefault(int(rows["w"][k] % np.uint64(self.buckets)), []).append((row, raw[rows["at"][k] : rows["at"][k] + self.least].tobytes()))
            yield from _packed(("string", bucket, _with_text(part)) for bucket, part in out.items())

    def sorted_strings(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans by the suffix array of a partition's strings."""
        blobs = _blobs(batches)
        spans = unpack(blobs.get("span", []), SPAN)
        parts = [_without_text(b, self.least) for b in blobs.get("string", [])]
        if parts:
            rows = {c: np.concatenate([p[0][c] for p in parts]) for c in STRING}
            found = repeated_starts([s for p in parts for s in p[1]], rows, self.least)
            spans = united({c: np.concatenate(v) for c, v in _joined(spans, found).items()})
        yield from _packed(dealt("span", doc_bucket(spans, self.buckets), spans, SPAN))


def _joined(a: Columns, b: Columns) -> dict[str, list[np.ndarray]]:
    return {c: [a[c].astype(np.int64), b[c].astype(np.int64)] for c in SPAN}


def _slices(rows: Columns) -> dict[tuple[int, int], slice]:
    """Where each document's rows stand, in rows that are in place order."""
    did, dk = rows["did"], rows["dk"]
    if not len(did):
        return {}
    new = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (dk[1:] != dk[:-1])]))
    ends = [*new[1:].tolist(), len(did)]
    return {(int(did[i]), int(dk[i])): slice(i, j) for i, j in zip(new.tolist(), ends, strict=True)}


def _with_text(part: list[tuple[Columns, bytes]]) -> bytes:
    rows = {c: np.concatenate([p[0][c] for p in part]) for c in STRING}
    return len(part).to_bytes(4, "little") + pack(rows, STRING) + b"".join(p[1] for p in part)


def _without_text(blob: bytes, least: int) -> tuple[Columns, list[np.ndarray]]:
    n = int.from_bytes(blob[:4], "little")
    head = 4 + n * sum(np.dtype(k).itemsize for k in STRING.values())
    rows = unpack([blob[4:head]], STRING)
    ends = np.cumsum(rows["n"].astype(np.int64) + least - 1)
    raw = np.frombuffer(blob, np.uint8, offset=head)
    return rows, np.split(raw, ends[:-1])


DOCUMENT = T.StructType([T.StructField("did", T.LongType()), T.StructField("dk", T.LongType()), T.StructField("spans", T.BinaryType()), T.StructField("candidates", T.BinaryType())])


def _document_batch(rows: list[tuple]) -> pa.RecordBatch:
    did, dk, spans, candidates = zip(*rows, strict=True)
    arrays = [pa.array(did, pa.int64()), pa.array(dk, pa.int64()), pa.array(spans, pa.binary()), pa.array(candidates, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, DOCUMENT.names)


def repeated_spans(docs: DataFrame, least: int = LEAST, hot: int = HOT, bucket_text: int = BUCKET_TEXT) -> DataFrame:
    """One row per document: doc_id, text, spans (packed pairs of start and end in UTF-8 bytes).

    Spans are the maximal runs of bytes that are covered by a string of
    ``least`` bytes which also starts earlier: in a document with a smaller
    doc_id, or further up in the same one, overlaps included.

    Nulls: a null text is empty; a null doc_id sorts after all others.
    Documents that share a doc_id are ordered by 32 bits of a hash of their
    text, and rows that repeat as a whole are one document.  Texts shorter than
    ``least`` have no spans.  Further columns are not read.
    """
    if not 1 <= least <= 155:
        raise ValueError("least must be 1 to 155 bytes")
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "suffix")
    text = empty_if_null("text")
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    base = docs.select("doc_id", did.alias("did"), F.shiftrightunsigned(F.xxhash64(text), 32).alias("dk"), text.alias("text"))
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, -(-total // bucket_text))
    job = SuffixDedup(least, buckets, hot)
    anchors = base.select("did", "dk", "text").mapInArrow(job.anchors, PACKED).repartition(buckets, "bucket")
    resolved = anchors.mapInArrow(job.resolved, PACKED).repartition(buckets, "bucket")
    resolved.mapInArrow(job.by_document, DOCUMENT).write.parquet(f"{folder}/coarse")
    coarse = spark.read.parquet(f"{folder}/coarse")
    open_ = coarse.filter(F.octet_length("candidates") > 0).select("did", "dk", "candidates")
    texts = base.select("did", "dk", "text").join(open_.hint("shuffle_hash"), ["did", "dk"])
    strings = texts.mapInArrow(job.strings, PACKED).repartition(buckets, "bucket")
    fine = strings.mapInArrow(job.sorted_strings, PACKED).repartition(buckets, "bucket").mapInArrow(job.by_document, DOCUMENT)
    fine.select("did", "dk", F.col("spans").alias("fine")).write.parquet(f"{folder}/fine")
    fine = spark.read.parquet(f"{folder}/fine")
    both = coarse.select("did", "dk", "spans").join(fine, ["did", "dk"], "full")
    spans = both.select("did", "dk", F.concat(F.coalesce("spans", F.lit(b"")), F.coalesce("fine", F.lit(b""))).alias("spans"))
    return base.join(spans.hint("shuffle_hash"), ["did", "dk"], "left").select("doc_id", "text", "spans")


def span_list(blob: bytes | None) -> list[tuple[int, int]]:
    """Maximal runs from packed pairs in any order."""
    pairs = np.frombuffer(blob or b"", "<u4").reshape(-1, 2)
    out: list[tuple[int, int]] = []
    for low, high in sorted(map(tuple, pairs.tolist())):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for low, high in spans:
        out.append(data[at:low])
        at = high
    return b"".join([*out, data[at:]])


def dedup_substrings(docs: DataFrame, least: int = LEAST, *, keep_bytes: bool = True, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, starts, ends of the removed runs, kept_sha256, and kept (bytes).

    ``kept`` need not be valid UTF-8, as a string may begin or end within a character; ``keep_bytes=False``
    leaves it null.  See :func:`repeated_spans` for what is removed.
    """
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_bytes", T.LongType())]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends")]
        + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", GATHERED):
            raw, at = utf8_buffers(batch.column("text"))
            rows = []
            for i, blob in enumerate(batch.column("spans").to_pylist()):
                data, spans = raw[at[i] : at[i + 1]].tobytes(), span_list(blob)
                kept = without_spans(data, spans)
                rows.append((len(data), [s for s, _ in spans], [e for _, e in spans], hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], schema.names)

    return repeated_spans(docs, least, **sizes).mapInArrow(run, schema)
