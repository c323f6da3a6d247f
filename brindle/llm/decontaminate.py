"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import CHUNK_BYTES, chunked, content_key, utf8_buffers, words_of
from brindle.session import scratch_path

#: Text of the benchmark that one pass over the documents searches for.
BLOCK_BYTES = 8 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class WuManber:
    """Patterns of one length in words.

    ``shift`` says, for the block of words at the end of the window, how far
    the window may move without missing a pattern.  A block that ends a
    pattern has shift 0 and a bucket of the patterns that end in it; those are
    compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.size = len(next(iter(patterns)))
        self.block = min(2, self.size)
        self.default = self.size - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for words, items in patterns.items():
            for end in range(self.block, self.size + 1):
                block = words[end - self.block : end] if self.block == 2 else words[end - 1]
                self.shift[block] = min(self.shift.get(block, self.default), self.size - end)
            self.buckets.setdefault(block, []).append((list(words), items))

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, items) of every occurrence."""
        size, default, shift, i, n = self.size, self.default, self.shift.get, self.size - 1, len(words)
        pair = self.block == 2
        while i < n:
            block = (words[i - 1], words[i]) if pair else words[i]
            step = shift(block, default)
            if step:
                i += step
                continue
            first = i - size + 1
            for pattern, items in self.buckets[block]:
                if words[first : i + 1] == pattern:
                    yield first, items
            i += 1


def build(texts: Iterable[tuple[object, bytes]], window: int) -> list[WuManber]:
    """One searcher per pattern length: windows of ``window`` words, and whole items that are shorter."""
    by_size: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, data in texts:
        words = words_of(data)
        size = min(window, len(words))
        if not size:
            continue
        patterns = by_size.setdefault(size, {})
        for at in range(len(words) - size + 1):
            items = patterns.setdefault(tuple(words[at : at + size]), [])
            if not items or items[-1] != item:
                items.append(item)
    return [WuManber(by_size[k]) for k in sorted(by_size)]


def search(words: list[bytes], searchers: list[WuManber]) -> tuple[list[int], list[int], list[str]]:
    """Maximal runs of words inside occurrences, as starts and ends, and the items that occur."""
    hits: list[tuple[int, int]] = []
    items: set[str] = set()
    for searcher in searchers:
        for first, found in searcher.scan(words):
            hits.append((first, first + searcher.size))
            items.update(found)
    starts: list[int] = []
    ends: list[int] = []
    for first, end in sorted(hits):
        if ends and first <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(first)
            ends.append(end)
    return starts, ends, sorted(items)


def _pass(docs: DataFrame, texts: list[tuple[str, bytes]], window: int) -> DataFrame:
    """One pass over all documents with the patterns of one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("row_key", T.LongType()), *FOUND.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = build(shared.value, window)
        for batch in chunked(batches, "text", CHUNK_BYTES):
            data, at = utf8_buffers(batch.column("text"))
            raw, at = data.tobytes(), at.tolist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for low, high in zip(at, at[1:], strict=False):
                words = words_of(raw[low:high])
                for column, value in zip(out, (len(words), *search(words, searchers)), strict=True):
                    column.append(value)
            arrays = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *arrays], schema.names)

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of every document that lie in an occurrence of benchmark text.

    Returns one row per document: doc_id, row_key, n_words, starts and ends (maximal
    runs of hit words, end exclusive), items (sorted ids, as strings).  A
    document word is hit when it is inside an occurrence of ``window``
    consecutive words of an item, or of a whole item that has fewer words.

    The benchmark goes to the tasks in blocks of about ``block_bytes`` of text,
    one pass over the documents for each; several passes are merged by row.

    Nulls: a null text has no words and no items; an item with a null id hits
    words and is listed as the empty string.  Rows that repeat give the same
    result each.  Other columns of either table are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", content_key("doc_id", "text").alias("row_key"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    total = items.agg(F.sum(F.length("data"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item", "data"), F.lit(blocks))
    texts = lambda k: [(r.item, bytes(r.data)) for r in items.filter(block == k).toLocalIterator()]
    if blocks == 1:
        return _pass(docs, sorted(texts(0)), window)
    folder = scratch_path(spark, "decontaminate")
    for k in range(blocks):
        _pass(docs, sorted(texts(k)), window).write.parquet(f"{folder}/block={k}")
    return _merged(spark.read.parquet(folder))


def _merged(passes: DataFrame) -> DataFrame:
    """Results of several passes: words are hit, and items occur, if any pass says so."""
    words = F.flatten(F.collect_list(F.flatten(F.transform(F.arrays_zip("starts", "ends"), lambda r: F.sequence(r["starts"], r["ends"] - 1)))))
    rows = passes.groupBy("row_key", "block").agg(*[F.first(c).alias(c) for c in ("doc_id", "n_words", "starts", "ends", "items")], F.count("*").alias("times"))
    merged = rows.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(words)).alias("hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("times").alias("times"),
    )
    first = F.filter("hit", lambda x, i: (i == 0) | (F.get("hit", i - 1) != x - 1))
    last = F.filter("hit", lambda x, i: ~F.coalesce(F.get("hit", i + 1) == x + 1, F.lit(False)))
    return merged.select(
        "doc_id", "row_key", "n_words", first.alias("starts"), F.transform(last, lambda x: x + 1).alias("ends"), "items", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")
    ).drop("copy")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, with all their columns, in which no word is hit."""
    hit = decontaminate(docs, benchmark, window).filter(F.size("starts") > 0).select(F.col("row_key").alias("__row")).distinct()
    return docs.withColumn("__row", content_key("doc_id", "text")).join(hit, "__row", "left_anti").drop("__row")


def hit_words() -> Column:
    """Number of hit words from starts and ends."""
    size = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0), lambda a, b: a + b)
    return size.cast("long")
