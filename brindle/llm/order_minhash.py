"""Near-duplicate documents by order MinHash, confirmed by banded alignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import POWERS, chunked, content_key, mixed, utf8_buffers, word_hashes
from brindle.llm.components import classes
from brindle.session import scratch_path

WORDS = 5
#: Rarest words in a block.  A bucket of more is dealt to blocks that meet two by two, so a task holds two of them.
BLOCK = 1 << 20
#: Counters, by the first bits of a word, that put words in order, the rarest first.
ORDER_BITS = 18
#: Words that a pair must share among the rarest of both texts; see :func:`_rarest`.
SHARED = 16
#: Steps of counting shared words that are held at once.
STEPS = 1 << 21
#: Bytes of words on either side of a tile in which pairs are aligned.
TILE = 32 << 20
SIMILARITY = 0.8
#: Sketches per document and shingles in each.  Two texts that share a part J of their shingles
#: meet in a sketch with a chance of about J^2.
SKETCHES = 16
PICKED = 2
#: Further sketches of one shingle, which meet with a chance of J: at an edit similarity of 0.8 with edits
#: all over the text, J is 0.2, and J^2 too small for the others.
SINGLES = 24
#: Longer texts of fewer words than this meet by pieces that cannot all be edited; see :func:`piece_places`.
SHORT = 40
#: What a chunk of texts needs in hashes is about 60 times its bytes.
CHUNK = 1 << 19

_BASES, _BASES_BACK = (x.copy() for x in POWERS.upto(SHORT))
_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_ADD = mixed(np.arange(101, 165, dtype=np.uint64))


def shingles(words: np.ndarray, at: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, and the number of runs before each text.

    A text of fewer words, but not none, is one run.
    """
    counts = np.diff(at)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    before = np.concatenate([[0], np.cumsum(runs)])
    first = np.repeat(at[:-1] - before[:-1], runs) + np.arange(before[-1])
    length = np.repeat(np.minimum(counts, size), runs)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    total = length.astype(np.uint64)
    for k in range(size):
        total = mixed(total + np.where(k < length, padded[first + k], np.uint64(0)) * _ODD[k])
    return total, before


def label_occurrences(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes in which the n-th occurrence of a shingle in its text differs from the others."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    run = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    out = np.empty_like(hashes)
    out[order] = mixed(h + nth.astype(np.uint64) * _ADD[0])
    return out


def sketch(labelled: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED, first: int = 0) -> np.ndarray:
    """One key per sketch: the ``picked`` smallest labelled shingles under that sketch's hash, in text order.

    Sketches are numbered from ``first``, and each number has a hash of its own.
    """
    keys = np.empty(sketches, np.uint64)
    step = max(1, (1 << 18) // max(len(labelled), 1))
    for low in range(0, sketches, step):
        high = min(low + step, sketches)
        j = np.arange(first + low, first + high)
        h = labelled[None, :] * _ODD[j, None] + _ADD[j, None]
        at = np.argpartition(h, picked - 1, axis=1)[:, :picked] if len(labelled) > picked else np.broadcast_to(np.arange(len(labelled)), h.shape)
        at = np.sort(at, axis=1)
        key = _ADD[j].copy()
        for k in range(at.shape[1]):
            key = mixed(key * _ODD[40] + labelled[at[:, k]])
        keys[low:high] = key
    return keys


def banded_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most ``most``, else None.

    Alignment in a band of ``most`` diagonals on each side of the main one: for
    one edit after the other, every diagonal of the band keeps the furthest
    row that is reached.  Equal words are passed without cost.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    low = 0
    while low < n and low < m and a[low] == b[low]:
        low += 1
    while n > low and m > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[low:n], b[low:m]
    if not a or not b:
        return max(len(a), len(b))
    # Furthest-reaching points per diagonal: after e edits, reach[d] is the row reached on column - row = d.
    n, m = len(a), len(b)
    reach = {0: _slide(a, b, 0, 0)}
    for e in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return e
        if e == most:
            return None
        further = {}
        for d in range(-min(e + 1, most, n), min(e + 1, most, m) + 1):
            at = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -2))
            at = min(at, n, m - d)
            if at >= 0 and at + d >= 0:
                further[d] = _slide(a, b, at, d)
        reach = further
    return None


def _slide(a: list, b: list, i: int, d: int) -> int:
    n, m = len(a), len(b)
    while i < n and i + d < m and a[i] == b[i + d]:
        i += 1
    return i


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length, in words, is at least ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return True
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most or longer - _common(a, b) > most:
        return False
    return banded_distance(a.tolist(), b.tolist(), most) is not None


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common, each as often as both have it: no alignment keeps more."""
    x, y = np.sort(a), np.sort(b)
    values, counts = np.unique(x, return_counts=True)
    low, high = np.searchsorted(y, values), np.searchsorted(y, values, side="right")
    return int(np.minimum(counts, high - low).sum())


def document_sketches(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, d1, d2, n_words, keys): digests of the word sequence and the order-MinHash keys.

    keys is empty for a text without words.
    """
    schema = T.StructType(
        [T.StructField("row_key", T.LongType()), docs.schema["doc_id"]]
        + [T.StructField(c, T.LongType()) for c in ("d1", "d2", "n_words")]
        + [T.StructField("keys", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", CHUNK):
            words, at = word_hashes(*utf8_buffers(batch.column("text")))
            runs, before = shingles(words, at)
            labelled = label_occurrences(runs, before)
            digests = _sequence_digests(words, at)
            edges = zip(before, before[1:], at, at[1:], strict=False)
            keys = [_keys(labelled[i:j], words[a:b]) if j > i else np.empty(0, np.int64) for i, j, a, b in edges]
            arrays = [pa.array(x.view(np.int64)) for x in digests]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), *arrays, pa.array(np.diff(at).astype(np.int64)), pa.array(keys, pa.list_(pa.int64()))], schema.names
            )

    return docs.select(content_key("doc_id", "text").alias("row_key"), "doc_id", "text").mapInArrow(run, schema)


def _keys(labelled: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of the sketches in their order, then those of the pieces of a short text."""
    return np.concatenate([sketch(labelled), sketch(labelled, SINGLES, 1, SKETCHES), piece_keys(words)]).view(np.int64)


@lru_cache(maxsize=2 * SHORT)
def piece_places(n: int, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, start and end of the pieces that a text of ``n`` words may share with one that is as long or longer.

    Two texts of which the longer has m words are linked by at most t edits, t
    the whole part of (1 - least) m.  Of t + 1 pieces of the longer one, one
    stands unchanged in the other.  Moved by d words, it costs |d| edits before
    it and |n - m - d| behind it, together at most t.  With m below ``SHORT``
    all these places are few, and a pair cannot be missed.
    """
    places = []
    for m in range(n, SHORT):
        t = int((1 - least) * m + 1e-9)
        if not t or m - n > t:
            continue
        cuts = [i * m // (t + 1) for i in range(t + 2)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            for d in range(-((m - n + t) // 2), (n - m + t) // 2 + 1):
                if 0 <= a + d and b + d <= n:
                    places.append((m * SHORT + i, a + d, b + d))
    found = np.array(places, np.int64).reshape(-1, 3)
    return found[:, 0].astype(np.uint64), found[:, 1], found[:, 2]


def piece_keys(words: np.ndarray) -> np.ndarray:
    """A key for each place of :func:`piece_places`: what stands there, the number of the piece and the longer length."""
    if not len(words) or len(words) >= SHORT:
        return np.empty(0, np.uint64)
    number, start, end = piece_places(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _BASES[: len(words)], dtype=np.uint64)])
    return np.unique(mixed((sums[end] - sums[start]) * _BASES_BACK[start] + mixed(number + np.uint64(1))))


def _sequence_digests(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of the word sequence of every text."""
    place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    out = []
    for k in (50, 51):
        terms = mixed(words * _ODD[k] + place.astype(np.uint64) * _ODD[k + 2])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        out.append(mixed(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)))
    return out


def _sequences(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row_key, words) of the texts of ``nodes(row_key)``: word ids, four bytes each."""
    texts = docs.select(content_key("doc_id", "text").alias("row_key"), "text")
    wanted = texts.join(nodes, "row_key", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", CHUNK):
            words, at = word_hashes(*utf8_buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), _packed((words >> np.uint64(32)).astype("<u4"), at)], ["row_key", "words"])

    return wanted.mapInArrow(run, "row_key long, words binary")


def _packed(words: np.ndarray, at: np.ndarray) -> pa.Array:
    raw = words.tobytes()
    return pa.array([raw[4 * i : 4 * j] for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.binary())


def _word_counts(sequences: DataFrame) -> np.ndarray:
    """How often words with the same first bits stand in the texts, as many numbers as there are such bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in chunked(batches, "words", CHUNK):
            words = utf8_buffers(batch.column("words"))[0].view("<u4")
            total += np.bincount(words >> np.uint32(32 - ORDER_BITS), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bits", "n"])

    found = sequences.select("words").mapInArrow(run, "bits int, n long").groupBy("bits").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    counts[found.column("bits").to_numpy()] = found.column("n").to_numpy()
    return counts


def _rarest(sequences: DataFrame, least: float) -> DataFrame:
    """(node, rare): of each text, sorted by how often the words stand in all of them, the first t + ``SHARED`` words.

    A text of n words has at most t edits to one that is as long or shorter, so it shares
    n - t words with it, and more with a longer one.  Of the words that two such texts
    share, the k-th in any one order of all words stands among the first t + k of either.
    So similar texts share ``SHARED`` of these words, or all they must share if that is
    less; which order it is does not matter, but rare words are shared by few.
    """
    shared = sequences.sparkSession.sparkContext.broadcast(_word_counts(sequences))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "words", CHUNK):
            raw, at = utf8_buffers(batch.column("words"))
            words, at = raw.view("<u4"), at // 4
            sizes = np.diff(at)
            taken = np.minimum(sizes, _edits(sizes, least) + SHARED)
            text = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((words, shared.value[words >> np.uint32(32 - ORDER_BITS)], text))
            first = order[np.arange(len(words)) - at[text] < taken[text]]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), _packed(words[first], np.concatenate([[0], np.cumsum(taken)]))], ["node", "rare"])

    return sequences.select("row_key", "words").mapInArrow(run, "node long, rare binary")


def _edits(longer: np.ndarray, least: float) -> np.ndarray:
    """The most edits that two similar texts have, the longer of ``longer`` words."""
    return ((1 - least) * longer + 1e-9).astype(np.int64)


def _verified(pairs: DataFrame, texts: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """Of the distinct pairs (a, b) those whose texts align, or enough of them for the same classes.

    Pairs are dealt to tiles by their two ends, and a tile gets the words of
    each of its texts once.  A tile holds a part of all texts on either side that
    is the same whichever texts have most pairs.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    size = nodes.join(texts.select("node", "n_words"), "node").agg(F.sum("n_words")).first()[0] or 0
    side = max(1, -(-4 * size // TILE))
    tiled = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(side)).alias("x"), F.pmod(F.xxhash64("b"), F.lit(side)).alias("y"))
    needed = tiled.select(F.col("x").alias("u"), F.col("y").alias("v"), F.explode(F.array("a", "b")).alias("row_key")).distinct()
    words = needed.join(sequences.select("row_key", "words"), "row_key")

    def run(found: pa.Table, given: pa.Table) -> pa.Table:
        held = {k: np.frombuffer(w, "<u4") for k, w in zip(given.column("row_key").to_pylist(), given.column("words").to_pylist(), strict=True)}
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        links = []
        for a, b in zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True):
            x, y = top(a), top(b)
            if x != y and similar(held[a], held[b], least):
                root[max(x, y)] = min(x, y)
                links.append((a, b))
        return pa.table({c: pa.array([p[k] for p in links], pa.int64()) for k, c in enumerate("ab")})

    return tiled.groupBy("x", "y").cogroup(words.groupBy("u", "v")).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, row_key, class_id, class_size, kept.

    Two texts are linked when 1 - edit distance / longer length over their
    words is at least ``least``; classes are what links connect; class_id is
    the smallest doc_id of the class and that document is kept.

    Texts with the same words collapse first.  A bucket holds the texts with
    one sketch key.  Each is compared with the first text of the bucket's largest
    class; a text that stays outside that class is compared with every text of
    the bucket that no link has joined to it and that shares enough of its rarest
    words.  So classes are those of all pairs that share a bucket, but many unlike
    texts of one passage do not meet pair by pair.

    Nulls: a null text has no words; texts without words are one class.  A null
    doc_id sorts after all others.  Rows that share the class id are all kept.
    Further columns are not read.
    """
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "near")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    facts = written(document_sketches(docs), "facts")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    groups = facts.groupBy("d1", "d2").agg(first, F.first("keys").alias("keys"), F.first("n_words").alias("n_words"))
    texts = written(groups.select("d1", "d2", F.col("first.row_key").alias("node"), F.col("first.doc_id").alias("least_id"), "keys", "n_words"), "texts")
    roots = _linked(docs, texts, written, least)
    placed = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = facts.select("d1", "d2", "doc_id", "row_key").join(placed.select("d1", "d2", "root"), ["d1", "d2"])
    sizes = members.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = members.select("doc_id", "row_key", "root").join(sizes, "root")
    return out.select("doc_id", "row_key", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def _linked(docs: DataFrame, texts: DataFrame, written, least: float) -> DataFrame:
    """(node, root) of the texts that share a bucket with a similar text, a bucket of a sketch or of a piece.

    The texts of each mixed bucket are compared with the first text of its
    largest class, once before anything is known and once more where links have
    made another class the largest.  That leaves few texts outside where texts are
    alike; each of them then meets the texts of the bucket with which it shares rare words.
    A bucket of two texts is done with the first comparison.
    """
    keys = texts.select("node", F.col("n_words").cast("int").alias("size"), F.posexplode("keys").alias("j", "key"))
    sketch_or_piece = F.least("j", F.lit(SKETCHES + SINGLES))
    rows = keys.select(F.xxhash64(sketch_or_piece, "key").alias("bucket"), "node", "size")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    rows = written(rows.join(shared, "bucket"), "rows")
    sequences = written(_sequences(docs, rows.select(F.col("node").alias("row_key")).distinct()), "sequences")
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    edges = None
    live = written(_mixed_buckets(rows, roots), "live-0")
    longer = F.greatest("size", "first.size")
    near = F.abs(F.col("size") - F.col("first.size")) <= F.floor(F.lit(1 - least) * longer + F.lit(1e-9))
    for again in (False, True):
        pairs = live.filter("root <> major").filter(near)
        if again:
            pairs = pairs.filter("not (first.node <=> first_before)")
        if pairs.isEmpty():
            break
        pairs = written(pairs.select(F.col("node").alias("a"), F.col("first.node").alias("b")).distinct(), f"pairs-{int(again)}")
        found = written(_verified(pairs, texts, sequences, least), f"edges-{int(again)}")
        if found.isEmpty():
            break
        edges = found if edges is None else edges.unionAll(found)
        roots = classes(edges)
        before = live.select("bucket", "node", "size", F.col("first.node").alias("first_before"))
        live = written(_mixed_buckets(before, roots), f"live-{1 + again}")
    live = live.filter("n > 2")
    if live.isEmpty():
        return roots
    pairs = written(_candidates(_blocks(live, least), sequences, least).distinct(), "pairs-blocks")
    found = written(_verified(pairs, texts, sequences, least), "edges-blocks")
    if found.isEmpty():
        return roots
    return classes(found if edges is None else edges.unionAll(found))


def _blocks(live: DataFrame, least: float) -> DataFrame:
    """(bucket, node, size, root, out, earlier, own, low, high): every text in each pair of blocks (low, high) where its own block meets another.

    ``out`` says that a text is outside the largest class of its bucket, and ``earlier`` are
    its buckets before this one.  A bucket of at most ``BLOCK`` words is one block.  In a larger one, texts
    outside the largest class and texts of that class are dealt to
    blocks apart, the former numbered first.  A block of the former meets all blocks.
    """
    held = live.groupBy("node").agg(F.collect_list("bucket").alias("held"))
    listed = live.join(held, "node").withColumn("earlier", F.filter("held", lambda b: b < F.col("bucket")))
    sized = listed.withColumn("out", F.col("root") != F.col("major"))
    cost = F.least("size", F.floor(F.lit(1 - least) * F.col("size")) + SHARED)

    def parts(of: Column) -> Column:
        return F.coalesce(F.ceil(F.sum(F.when(of, cost)) / BLOCK), F.lit(0).cast("long"))

    dealt_to = live.withColumn("out", F.col("root") != F.col("major")).groupBy("bucket")
    buckets = dealt_to.agg((F.sum(cost) <= BLOCK).alias("small"), parts(F.col("out")).alias("outer"), parts(~F.col("out")).alias("inner"))
    own = F.when(F.col("out"), F.pmod(F.xxhash64("node"), "outer")).otherwise(F.col("outer") + F.pmod(F.xxhash64("node"), "inner"))
    own = F.when(F.col("small"), F.lit(0).cast("long")).otherwise(own)
    met = F.when(F.col("small"), F.lit(1).cast("long")).when(F.col("out"), F.col("outer") + F.col("inner")).otherwise(F.col("outer"))
    held_names = ["bucket", "node", "size", "root", "out", "earlier"]
    dealt = sized.join(buckets, "bucket").select(*held_names, own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), met - 1)).alias("other"))
    return dealt.select(*held_names, "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def _candidates(blocks: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a below b, of texts of different classes that meet in a pair of blocks and may be similar.

    What meets is the length of each text and its rarest words; all words follow for the pairs that are left.
    A pair comes from the first of the buckets that hold both texts.
    """
    names = ["bucket", "low", "high"]
    met = blocks.join(_rarest(sequences, least), "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, names):
            pairs = _possible(group, least)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return met.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long")


def _runs(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Sorted rows, by runs that agree in all of ``names``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            this = tuple(key[:, low].tolist())
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = this
    if held:
        yield pa.Table.from_batches(held)


def _possible(group: pa.Table, least: float) -> np.ndarray:
    """Pairs of a block, or of two, that lengths and rarest words leave possible and that no earlier bucket holds.

    One text of a pair is outside the bucket's largest class.  Shared words are counted along the
    lists of the texts that have them, for some of the texts at once.
    """
    node, label, own, size = (group.column(c).to_numpy() for c in ("node", "root", "own", "size"))
    out = group.column("out").to_numpy(zero_copy_only=False)
    same = group.column("low")[0] == group.column("high")[0]
    right = np.ones(len(node), bool) if same else own == group.column("high")[0].as_py()
    rows = np.flatnonzero(out & (right if same else ~right))
    word, at = _labelled_words(group.column("rare").to_pylist())
    held = np.bincount(word)
    start = np.cumsum(held) - held
    text = np.repeat(np.arange(len(node)), np.diff(at))[np.argsort(word, kind="stable")]
    steps = np.concatenate([[0], np.cumsum(held[word])])[at]
    found, low = [np.empty((0, 2), np.int64)], 0
    while low < len(rows):
        cost = np.cumsum((steps[1:] - steps[:-1])[rows[low:]] + len(node))
        part = rows[low : low + max(1, int(np.searchsorted(cost, STEPS, side="right")))]
        low += len(part)
        mine = word[_spread(at[part], at[part + 1])]
        who = np.repeat(np.repeat(np.arange(len(part)), at[part + 1] - at[part]), held[mine])
        shared = np.bincount(who * len(node) + text[_spread(start[mine], start[mine] + held[mine])], minlength=0)
        hit = np.flatnonzero(shared)
        x, y = part[hit // len(node)], hit % len(node)
        longer = np.maximum(size[x], size[y]).astype(np.int64)
        most = _edits(longer, least)
        on = (label[x] != label[y]) & (np.abs(size[x] - size[y]) <= most) & (shared[hit] >= np.minimum(SHARED, longer - most))
        on &= right[y] & ((y > x) | ~out[y] | (not same))
        found.append(np.column_stack([x[on], y[on]]))
    pairs = np.concatenate(found)
    pairs = pairs[~_met_before(pairs, group.column("earlier").to_pylist())]
    return np.sort(node[pairs], axis=1)


def _labelled_words(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of every word, its n-th occurrence in a text apart from the others, and the words before each text."""
    words = np.frombuffer(b"".join(packed), "<u4").astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int64)
    new = np.ones(len(words), bool)
    new[1:] = words[1:] != words[:-1]
    new[at[:-1][at[:-1] < len(words)]] = True
    run = np.flatnonzero(new)
    nth = np.arange(len(words)) - np.repeat(run, np.diff(np.append(run, len(words))))
    return np.unique(words | nth.astype(np.uint64) << np.uint64(32), return_inverse=True)[1], at


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All places from each of ``low`` up to its ``high``, one range after the other."""
    size = high - low
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _met_before(pairs: np.ndarray, earlier: list[list[int]]) -> np.ndarray:
    """Whether the two texts of each pair have one of their earlier buckets in common."""
    at = np.concatenate([[0], np.cumsum([len(e) for e in earlier])]).astype(np.int64)
    met = np.zeros(len(pairs), bool)
    if not at[-1]:
        return met
    keys, bucket = np.unique(np.concatenate([np.array(e, np.int64) for e in earlier]), return_inverse=True)
    codes = np.sort(np.repeat(np.arange(len(earlier)), np.diff(at)) * len(keys) + bucket)
    x, y = pairs[:, 0], pairs[:, 1]
    sizes = at[x + 1] - at[x]
    low, before = 0, np.concatenate([[0], np.cumsum(sizes)])
    while low < len(pairs):
        high = max(low + 1, int(np.searchsorted(before, before[low] + STEPS, side="right")) - 1)
        i = np.repeat(np.arange(low, high), sizes[low:high])
        code = y[i] * len(keys) + bucket[_spread(at[x[low:high]], at[x[low:high] + 1])]
        place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        met[i[codes[place] == code]] = True
        low = high
    return met


def _mixed_buckets(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one class: each with its root, the bucket's size, the root of the largest class and that class's first text.

    Classes are counted in each task before the shuffle; a bucket meets as one row per class.
    """
    labelled = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("first"))
    largest = F.max(F.struct("n", F.bitwise_not("root").alias("order"), "root", "first")).alias("l")
    buckets = parts.groupBy("bucket").agg(largest, F.count("*").alias("classes"), F.sum("n").alias("n")).filter("classes > 1")
    return labelled.join(buckets.select("bucket", "n", F.col("l.root").alias("major"), F.col("l.first").alias("first")), "bucket")


def kept_documents(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents of which one stays per class, with all their columns."""
    kept = near_duplicates(docs, least).filter("kept").select("row_key").distinct()
    return docs.withColumn("__row", content_key("doc_id", "text")).join(kept.withColumnRenamed("row_key", "__row"), "__row", "left_semi").drop("__row")

