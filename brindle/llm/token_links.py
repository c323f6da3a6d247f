"""Links between the tokens of two tokenizers over the same text.

Tokens and the bytes they cover form incidence matrices A and B in compressed
rows.  Gustavson's row products A B' link the tokens that share a byte; the
products of the tokens' incidence with groups (bytes between two places where
tokens of both end) link the tokens of one group.  A text falls into units at
spaces that no token crosses; a unit's links are worked out once per task.  The
products of documents with units and of units with id pairs give the id pairs
of every document, and those with the corpus-wide counts give its sums.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.chunks import from_planes, numbered_chunks, planes, stored_by_chunk
from brindle.llm.common import chunked, empty_if_null, mixed
from brindle.session import scratch_path

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_TEXT = 8 << 20
#: Text of which the units and id pairs are counted at once.
STEP_TEXT = 1 << 20
#: Id pairs whose counts meet in one task.
PAIRS = 1 << 20
#: Bytes of different units a task keeps the links of.
KEPT_UNITS = 32 << 20


# --- sparse matrices ---


@dataclass
class Csr:
    """A sparse matrix in compressed rows."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """Row of every entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def times(self, vector: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(self.data * vector[self.indices], 0), self.indptr[:-1]) * (np.diff(self.indptr) > 0)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges of ``counts`` numbers from each start."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def collected(rows: np.ndarray, columns: np.ndarray, data: np.ndarray, n_rows: int) -> Csr:
    """Entries of the same place added up."""
    if len(rows) and not ((rows[1:] > rows[:-1]) | (rows[1:] == rows[:-1]) & (columns[1:] >= columns[:-1])).all():
        wide = int(columns.max()) + 1
        order = np.argsort(rows * wide + columns) if wide * n_rows < 1 << 62 else np.lexsort((columns, rows))
        rows, columns, data = rows[order], columns[order], data[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])
    first = np.flatnonzero(new)
    summed = np.add.reduceat(data, first) if len(first) else data
    indptr = np.searchsorted(rows[first], np.arange(n_rows + 1))
    return Csr(indptr, columns[first], summed)


def product(a: Csr, b: Csr) -> Csr:
    """Gustavson's product: row i is the sum of the rows of ``b`` at the entries of row i of ``a``."""
    counts = np.diff(b.indptr)[a.indices]
    at = ranges(b.indptr[a.indices], counts)
    return collected(np.repeat(a.rows, counts), b.indices[at], np.repeat(a.data, counts) * b.data[at], len(a.indptr) - 1)


def spans(lengths: np.ndarray) -> Csr:
    """Incidence of tokens with the bytes they cover, one token after another."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(ends, np.arange(ends[-1]), np.ones(ends[-1], np.int64))


def spans_transposed(lengths: np.ndarray) -> Csr:
    n = int(lengths.sum())
    return Csr(np.arange(n + 1), np.repeat(np.arange(len(lengths)), lengths), np.ones(n, np.int64))


def overlap_links(a: np.ndarray, b: np.ndarray) -> Csr:
    """From token lengths: which tokens overlap, and in how many bytes."""
    return product(spans(a), spans_transposed(b))


def groups_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of every token, and the number of groups."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    cuts = ends_a[np.append(ends_b, -1)[np.searchsorted(ends_b, ends_a)] == ends_a]
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), len(cuts)


def shared_group_links(group_a: np.ndarray, group_b: np.ndarray, groups: int) -> Csr:
    """Which tokens stand in one group."""
    a = Csr(np.arange(len(group_a) + 1), group_a, np.ones(len(group_a), np.int64))
    members = np.searchsorted(group_b, np.arange(groups + 1))
    return product(a, Csr(members, np.arange(len(group_b)), np.ones(len(group_b), np.int64)))


# --- tokens ---

#: A space after a visible character and before any other: tokens of neither tokenizer cross from the one to the other.
CUT = re.compile("(?<=[^\\s\u180e\u200b\ufeff\u2581]) (?=.)", re.S)
#: Texts without such a place are split at their spaces outright.
UNEVEN = re.compile("[\\s\u180e\u200b\ufeff\u2581] |^ | $", re.S)


#: Fixed value: how the byte-level vocabulary splits a text before it merges.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose kind has not changed with any edition of the character tables.
PLAIN = re.compile("[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")


def units_of(text: str) -> list[str]:
    """The units of a space and the text, each without its leading space."""
    if not UNEVEN.search(text):
        return text.split(" ")
    first, *others = CUT.split(" " + text)
    return [first[1:], *others]


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the rest from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both vocabularies, with the bytes of every entry."""

    def __init__(self, byte_level: str, pieces: str):
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.plain = self._plain()
        #: Whether no piece goes on behind a space that is not at its front.
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)

    def _plain(self):
        """The first vocabulary with a quicker engine, if its merges are in the order of their entries' numbers."""
        import json

        import tiktoken

        model = json.loads(self.a.to_str())["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("plain", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def units(self, text: str) -> list[str]:
        return units_of(text) if self.cuts else [text]

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return self._encode_a([" " + u for u in units]), self.b.encode(units, num_threads=1)

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        """Texts of characters that every engine takes alike go to the quick one, the others to the tokenizer itself."""
        plain = PLAIN.fullmatch
        odd = texts if self.plain is None else [t for t in texts if not plain(t)]
        slow = iter([e.ids for e in self.a.encode_batch_fast(odd, add_special_tokens=False)])
        if self.plain is None:
            return list(slow)
        quick = self.plain.encode_ordinary
        return [quick(t) if plain(t) else next(slow) for t in texts]


@lru_cache(maxsize=1)
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


@dataclass
class Units:
    """What is known of the units a task has met: tokens, groups and linked id pairs."""

    pair_base: int
    number: dict[str, int] = field(default_factory=dict)
    size: int = 0
    text: list[str] = field(default_factory=list)
    #: Per unit: tokens of A, tokens of B, groups, overlap links, shared-group links; all zero where the bytes differ.
    counts: list[np.ndarray] = field(default_factory=list)
    pairs: list[Csr] = field(default_factory=list)
    #: How often each unit has been met.
    used: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def learn(self, both: Tokenizers, units: list[str]) -> None:
        ids_a, ids_b = both.encode(units)
        spelled = [(" " + u).encode() for u in units]
        fine = np.array([len(w) > 1 for w in spelled], bool)
        for ids, table in ((ids_a, both.bytes_a), (ids_b, both.bytes_b)):
            fine &= _spell(ids, table, spelled)
        if not fine.all():
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, fine.tolist(), strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        bytes_a, bytes_b = both.sizes_a[flat_a], both.sizes_b[flat_b]
        links = overlap_links(bytes_a, bytes_b)
        group_a, group_b, groups = groups_of(bytes_a, bytes_b)
        shared = shared_group_links(group_a, group_b, groups)
        unit_a = np.repeat(np.arange(len(units)), n_a)
        pair = flat_a[links.rows] * self.pair_base + flat_b[links.indices]
        self.pairs.append(collected(unit_a[links.rows], pair, np.ones(len(pair), np.int64), len(units)))
        last = np.ones(len(group_a), bool)
        last[:-1] = group_a[1:] != group_a[:-1]
        per_unit = [n_a, n_b] + [np.bincount(unit_a[rows], minlength=len(units)) for rows in (np.flatnonzero(last), links.rows, shared.rows)]
        self.counts.append(np.column_stack([*per_unit, fine.astype(np.int64)]))
        self.text += _group_texts(both, flat_a, flat_b, group_a, group_b, groups, unit_a, len(units))
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))
        self.used = np.concatenate([self.used, np.zeros(len(units), np.int64)])
        self.size += sum(map(len, units)) + 64 * len(units)

    def trimmed(self) -> Units:
        """The units that have been met more than once since the last time."""
        counts, pairs = self.merged()
        keep = np.flatnonzero(self.used > 1)
        names = list(self.number)
        out = Units(self.pair_base, text=[self.text[i] for i in keep.tolist()], counts=[counts[keep]])
        sizes = np.diff(pairs.indptr)[keep]
        at = ranges(pairs.indptr[keep], sizes)
        out.pairs = [Csr(np.concatenate([[0], np.cumsum(sizes)]), pairs.indices[at], pairs.data[at])]
        out.number = {names[i]: k for k, i in enumerate(keep.tolist())}
        out.used = np.zeros(len(keep), np.int64)
        out.size = sum(map(len, out.number)) + 64 * len(keep)
        return out

    def merged(self) -> tuple[np.ndarray, Csr]:
        if len(self.counts) > 1:
            self.counts = [np.concatenate(self.counts)]
            sizes = [m.indptr[-1] for m in self.pairs]
            indptr = np.concatenate([[0], *[m.indptr[1:] + s for m, s in zip(self.pairs, np.cumsum([0, *sizes[:-1]]), strict=True)]])
            self.pairs = [Csr(indptr, np.concatenate([m.indices for m in self.pairs]), np.concatenate([m.data for m in self.pairs]))]
        return self.counts[0], self.pairs[0]


def _spell(ids: list[list[int]], table: list[bytes], spelled: list[bytes]) -> np.ndarray:
    """Which token lists have just the bytes wanted; all at once where none differs."""
    got = [b"".join(map(table.__getitem__, x)) for x in ids]
    return np.ones(len(got), bool) if got == spelled else np.fromiter(map(eq, got, spelled), bool, len(got))


def _group_texts(both: Tokenizers, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int, unit_a: np.ndarray, units: int) -> list[str]:
    """Per unit its groups as decimal ids: a1,a2|b1;a3|b2."""
    cuts_a, cuts_b = (np.searchsorted(g, np.arange(groups + 1)).tolist() for g in (group_a, group_b))
    named_a, named_b = (list(map(both.names.__getitem__, x.tolist())) for x in (a, b))
    each = [
        f"{named_a[i]}|{named_b[k]}" if j - i == m - k == 1 else ",".join(named_a[i:j]) + "|" + ",".join(named_b[k:m])
        for i, j, k, m in zip(cuts_a[:-1], cuts_a[1:], cuts_b[:-1], cuts_b[1:], strict=True)
    ]
    unit_of_group = unit_a[cuts_a[:-1]] if groups else np.empty(0, np.int64)
    edges = np.searchsorted(unit_of_group, np.arange(units + 1)).tolist()
    return [each[i] if j - i == 1 else ";".join(each[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]


# --- the job ---

DOC_FIELDS = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_shared")] + [
    T.StructField("groups_sha256", T.StringType()),
    T.StructField("pairs", T.BinaryType()),
]


@dataclass
class Aligned:
    """Documents of a chunk: counts, digests, and the matrix of documents and id pairs."""

    counts: np.ndarray
    digests: list[str]
    pairs: Csr


def aligned(texts: list[str], both: Tokenizers, known: Units) -> Aligned:
    split = [both.units(t) if t else [] for t in texts]
    missing = list(dict.fromkeys(u for u in chain.from_iterable(split) if u not in known.number))
    if missing or not known.counts:
        known.learn(both, missing)
    counts, links = known.merged()
    number, text = known.number, known.text
    sizes = np.array([len(u) for u in split], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    units = [list(map(number.__getitem__, u)) for u in split]
    unit = np.fromiter(chain.from_iterable(units), np.int64, len(doc))
    known.used += np.bincount(unit, minlength=len(known.used))
    # A document has no tokens if one of its units has none.
    fine = (np.bincount(doc, weights=counts[unit, 5] == 0, minlength=len(texts)) == 0) & (sizes > 0)
    keep = fine[doc]
    of_units = collected(doc[keep], unit[keep], np.ones(keep.sum(), np.int64), len(texts))
    sums = np.column_stack([of_units.times(counts[:, k]) for k in range(5)])
    digests = [hashlib.sha256(";".join([text[u] for u in own]).encode()).hexdigest() if ok else "" for own, ok in zip(units, fine.tolist(), strict=True)]
    return Aligned(sums, digests, product(of_units, links))


def bucket_of(pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs by bucket, and the buckets in that order."""
    bucket = ((mixed(pairs.astype(np.uint64)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def edges_of(bucket: np.ndarray) -> list[tuple[int, int]]:
    at = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
    return list(zip(at[:-1], at[1:], strict=True))


class TokenLinks:
    """The steps for one corpus."""

    def __init__(self, byte_level: str, pieces: str, buckets: int, chunk_text: int):
        self.paths, self.buckets, self.chunk_text = (byte_level, pieces), buckets, chunk_text

    def align(self, batches: Iterable[pa.RecordBatch], schema: T.StructType) -> Iterator[pa.RecordBatch]:
        """A row per document, then one per bucket of the chunk's different id pairs with the documents that hold them."""
        both = tokenizers(*self.paths)
        base = len(both.bytes_b)
        known = Units(base)
        for chunk, part in numbered_chunks(batches, "text", self.chunk_text):
            if known.size > KEPT_UNITS:
                known = known.trimmed()
                known = known if 2 * known.size < KEPT_UNITS else Units(base)
            for table, found in self._numbered(chunk, part, both, known, schema):
                yield from table.to_batches() if found is None else self._asked(chunk, found, schema)

    def _numbered(self, chunk: int, part: list[pa.RecordBatch], both: Tokenizers, known: Units, schema: T.StructType):
        """Documents of the chunk with their pairs numbered in the order of the chunk's different pairs."""
        steps = [(b, aligned(b.column("text").to_pylist(), both, known)) for b in chunked(part, "text", STEP_TEXT)]
        held, inverse, docs = np.unique(np.concatenate([a.pairs.indices for _, a in steps]), return_inverse=True, return_counts=True)
        order, bucket = bucket_of(held, self.buckets)
        place = np.empty(len(held), np.int64)
        place[order] = np.arange(len(held))
        at = 0
        for batch, a in steps:
            n = len(a.pairs.indices)
            rank = place[inverse[at : at + n]]
            at += n
            rows = a.pairs.rows
            by = np.lexsort((rank, rows))
            rank, many, ends = rank[by], a.pairs.data[by], a.pairs.indptr.tolist()
            blobs = [planes(np.diff(rank[i:j], prepend=0), 4) + planes(many[i:j], 4) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield self._documents(chunk, batch, a, blobs, schema), None
        yield None, (held[order], docs[order], bucket)

    @staticmethod
    def _documents(chunk: int, batch: pa.RecordBatch, a: Aligned, blobs: list[bytes], schema: T.StructType) -> pa.Table:
        n = batch.num_rows
        arrays = [batch.column("doc_id"), *[pa.array(a.counts[:, k]) for k in range(5)], pa.array(a.digests, pa.string()), pa.array(blobs, pa.binary())]
        arrays += [pa.array(np.full(n, chunk)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
        return pa.table(arrays, names=schema.names)

    @staticmethod
    def _asked(chunk: int, found: tuple, schema: T.StructType) -> Iterator[pa.RecordBatch]:
        pairs, docs, bucket = found
        parts = edges_of(bucket)
        blobs = [planes(pairs[i:j], 8) + planes(docs[i:j], 4) for i, j in parts]
        if parts:
            n = len(parts)
            kinds = [f.dataType for f in schema.fields[:8]]
            from pyspark.sql.pandas.types import to_arrow_type

            arrays = [pa.nulls(n, to_arrow_type(k)) for k in kinds]
            arrays += [pa.array(np.full(n, chunk)), pa.array([int(bucket[i]) for i, _ in parts], pa.int64()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    def count(self, rows: pa.Table, base: int) -> pa.Table:
        """Documents that hold each pair, for every chunk that asked; and per first id the largest count, as chunk null."""
        blobs = rows.column("blob").to_pylist()
        sizes = [len(b) // 12 for b in blobs]
        pairs = np.concatenate([from_planes(b, n, 8) for b, n in zip(blobs, sizes, strict=True)]).astype(np.int64)
        docs = np.concatenate([from_planes(b, n, 4, 8 * n) for b, n in zip(blobs, sizes, strict=True)]).astype(np.int64)
        different, inverse = np.unique(pairs, return_inverse=True)
        total = np.zeros(len(different), np.int64)
        np.add.at(total, inverse, docs)
        back = total[inverse]
        ends = np.cumsum(sizes)
        out = [planes(pairs[e - n : e] // base, 4) + planes(back[e - n : e], 7) for n, e in zip(sizes, ends.tolist(), strict=True)]
        first = different // base
        run = np.flatnonzero(np.diff(first, prepend=-1))
        highest = planes(first[run], 4) + planes(np.maximum.reduceat(total, run), 7)
        chunk, bucket = rows.column("chunk").to_pylist(), rows.column("bucket").to_pylist()
        return pa.table({"chunk": pa.array([*chunk, None], pa.int64()), "bucket": pa.array([*bucket, bucket[0]], pa.int64()), "blob": pa.array([*out, highest], pa.binary())})


def _unpacked_counts(blobs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First ids and counts."""
    parts = [(from_planes(b, len(b) // 11, 4), from_planes(b, len(b) // 11, 7, len(b) // 11 * 4)) for b in blobs]
    none = [np.empty(0, np.uint64)]
    return tuple(np.concatenate(none + [p[k] for p in parts]).astype(np.int64) for k in (0, 1))


def align_documents(
    docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, *, chunk_text: int = CHUNK_TEXT, pairs: int = PAIRS
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256.

    ``n_links`` are pairs of tokens that overlap, ``n_shared`` pairs within one
    group.  The count of an id pair is the number of documents that hold it
    linked; ``n_best`` are links whose count is the highest of their first id,
    ``count_sum`` sums the counts over the links.

    Nulls: a null or empty text, and one whose tokens do not spell it, has no
    tokens: zeros and an empty digest.  A null doc_id stays null; each row
    counts as a document, so rows that repeat count each and come each time.
    An empty table gives an empty one; further columns are not read.
    """
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "tokens")
    texts = docs.select("doc_id", empty_if_null("text").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    job = TokenLinks(byte_level, pieces, max(1, -(-total // (16 * pairs))), chunk_text)
    schema = T.StructType(
        [docs.schema["doc_id"], *DOC_FIELDS, T.StructField("chunk", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("blob", T.BinaryType())]
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    rows = stored_by_chunk(texts.mapInArrow(lambda batches: job.align(batches, schema), schema), -(-total // (2 * chunk_text)) or 1, "tokens")
    asked = rows.filter(F.col("bucket").isNotNull()).select("chunk", "bucket", "blob").repartition(job.buckets, "bucket")
    base = len(tokenizers(byte_level, pieces).bytes_b)
    asked.groupBy("bucket").applyInArrow(lambda group: job.count(group, base), "chunk long, bucket long, blob binary").write.parquet(folder)
    answers = spark.read.parquet(folder)
    highest = highest_counts(answers, len(tokenizers(byte_level, pieces).bytes_a))
    out = T.StructType(
        [schema.fields[0], *DOC_FIELDS[:5], *[T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())]
    )

    def finish(documents: pa.Table, found: pa.Table) -> pa.Table:
        first, counts = _unpacked_counts(found.sort_by("bucket").column("blob").to_pylist())
        best = (counts == highest[first]).astype(np.int64)
        sums = np.zeros((documents.num_rows, 2), np.int64)
        for i, blob in enumerate(documents.column("pairs").to_pylist()):
            n = len(blob) // 8
            rank = np.cumsum(from_planes(blob, n, 4)).astype(np.int64)
            many = from_planes(blob, n, 4, 4 * n).astype(np.int64)
            sums[i] = many @ best[rank], many @ counts[rank]
        columns = [documents.column(c) for c in out.names[:6]]
        return pa.table([*columns, pa.array(sums[:, 0]), pa.array(sums[:, 1]), documents.column("groups_sha256")], names=out.names)

    by_chunk = rows.filter(F.col("bucket").isNull()).drop("bucket", "blob").groupBy("chunk")
    return by_chunk.cogroup(answers.filter(F.col("chunk").isNotNull()).groupBy("chunk")).applyInArrow(finish, out)


def highest_counts(answers: DataFrame, size: int) -> np.ndarray:
    """Highest count of each first id: as many numbers as the first vocabulary has entries."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for batch in batches:
            first, counts = _unpacked_counts(batch.column("blob").to_pylist())
            np.maximum.at(out, first, counts)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["first", "count"])

    each = answers.filter(F.col("chunk").isNull()).select("blob").mapInArrow(unpack, "first long, count long")
    out = np.zeros(size, np.int64)
    for row in each.groupBy("first").agg(F.max("count").alias("count")).toArrow().to_batches():
        out[row.column(0).to_numpy()] = row.column(1).to_numpy()
    return out


LINKED = (
    "n_units long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>, "
    "links array<struct<a: int, b: int, bytes: int>>, shared array<struct<a: int, b: int>>"
)


def link_documents(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """One row per document: doc_id, n_units, ids and groups of the tokens of both, and their links by place in the text.

    ``links`` are overlaps with the bytes they share, ``shared`` pairs of tokens
    in one group.  Empty lists where :func:`align_documents` finds no tokens.
    """
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(LINKED).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_level, pieces)
        for batch in chunked(batches, "text", STEP_TEXT):
            rows = [linked(t, both) for t in batch.column("text").to_pylist()]
            from pyspark.sql.pandas.types import to_arrow_schema

            kinds = to_arrow_schema(schema)
            columns = [batch.column("doc_id"), *[pa.array([r[k] for r in rows], kinds.field(k + 1).type) for k in range(len(kinds) - 1)]]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("doc_id", empty_if_null("text").alias("text")).mapInArrow(run, schema)


def linked(text: str, both: Tokenizers) -> tuple:
    units = both.units(text) if text else []
    encoded = both.encode(units) if units else ([], [])
    a, b = ([i for ids in x for i in ids] for x in encoded)
    wanted = (" " + text).encode()
    if not text or b"".join(map(both.bytes_a.__getitem__, a)) != wanted or b"".join(map(both.bytes_b.__getitem__, b)) != wanted:
        return 0, [], [], [], [], [], []
    sizes = [np.array([len(t[i]) for i in ids], np.int64) for t, ids in ((both.bytes_a, a), (both.bytes_b, b))]
    overlaps = overlap_links(*sizes)
    group_a, group_b, groups = groups_of(*sizes)
    shared = shared_group_links(group_a, group_b, groups)
    links = [{"a": i, "b": j, "bytes": n} for i, j, n in zip(overlaps.rows.tolist(), overlaps.indices.tolist(), overlaps.data.tolist(), strict=True)]
    pairs = [{"a": i, "b": j} for i, j in zip(shared.rows.tolist(), shared.indices.tolist(), strict=True)]
    return len(units), a, b, group_a.tolist(), group_b.tolist(), links, pairs
