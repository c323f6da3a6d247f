"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import chunked, utf8_buffers
from brindle.session import scratch_path

FEATURES = (
    "log_bytes log_words word_bytes upper digit space high stop symbol exclaim "
    "unique top_word adjacent symbol_end line_unique line_words"
).split()

#: Bytes of text worked on at once; running sums and word lists take about 100 times as much.
CHUNK = 1 << 20
#: Shares are moved away from 0 and 1 by this before the logit.
EPS = 2e-3

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[128:] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[ord("!")] = 7

_SYMBOL_ENDS = tuple(bytes([c]) for c in np.flatnonzero((_CLASS == 6) | (_CLASS == 7)).tolist())


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 0, 1)
    return np.log((share + EPS) / (1 - share + EPS))


def _byte_shares(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of each byte class in every text; 0 for empty texts."""
    kinds, sizes = _CLASS[raw], np.diff(at)
    shares = np.zeros((len(sizes), 7))
    for k in range(1, 8):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        shares[:, k - 1] = (total[at[1:]] - total[at[:-1]]) / np.maximum(sizes, 1)
    return shares


def _word_facts(data: bytes) -> tuple[float, ...]:
    words, lines = data.split(), data.split(b"\n")
    n = len(words)
    if not n:
        return (0.0,) * 8
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return (
        n,
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(w.endswith(_SYMBOL_ENDS) for w in words) / n,
        len(set(lines)) / len(lines),
        n / len(lines),
    )


def statistics_of(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row per text: logs of sizes, logits of shares.  Texts of any length, empty too."""
    data, ends = raw.tobytes(), at.tolist()
    shares = _byte_shares(raw, at)
    facts = np.array([_word_facts(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]).reshape(-1, 8)
    n, size, unique, top, adjacent, symbol_end, line_unique, line_words = facts.T
    logs = [np.log1p(np.diff(at)), np.log1p(n), np.log1p(size)]
    return np.column_stack(
        [*logs, *[_logit(s) for s in shares.T], *[_logit(x) for x in (unique, top, adjacent, symbol_end, line_unique)], np.log1p(line_words)]
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", CHUNK):
            x = statistics_of(*utf8_buffers(batch.column("text")))
            offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, x.ravel())], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors of the shrunk covariances and constants of the classes 0 and 1."""

    means: np.ndarray
    inverse_factors: np.ndarray
    constants: np.ndarray

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log posterior odds of class 1: half the difference of Mahalanobis distances, and the constants."""
        z = [(x - m) @ f.T for m, f in zip(self.means, self.inverse_factors, strict=True)]
        density = [c - 0.5 * np.einsum("ij,ij->i", v, v) for c, v in zip(self.constants, z, strict=True)]
        return density[1] - density[0]


def shrunk(covariance: np.ndarray, pooled: np.ndarray, to_pooled: float, to_scaled_identity: float) -> np.ndarray:
    mixed = (1 - to_pooled) * covariance + to_pooled * pooled
    target = np.eye(len(mixed)) * max(np.trace(mixed) / len(mixed), 1e-6)
    return (1 - to_scaled_identity) * mixed + to_scaled_identity * target


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float, to_scaled_identity: float) -> Discriminant | None:
    """From (count, sum, sum of outer products) per class; None unless both classes occur."""
    if len(moments) < 2:
        return None
    n = np.array([moments[k][0] for k in (0, 1)])
    means = np.array([moments[k][1] / moments[k][0] for k in (0, 1)])
    covariances = [moments[k][2] / moments[k][0] - np.outer(m, m) for k, m in zip((0, 1), means, strict=True)]
    pooled = sum(c * w for c, w in zip(covariances, n, strict=True)) / n.sum()
    factors = [np.linalg.cholesky(shrunk(c, pooled, to_pooled, to_scaled_identity)) for c in covariances]
    constants = [np.log(w / n.sum()) - np.log(np.diag(f)).sum() for w, f in zip(n, factors, strict=True)]
    return Discriminant(means, np.array([np.linalg.inv(f) for f in factors]), np.array(constants))


def class_moments(rows: DataFrame, shift: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Moments of ``x - shift`` per label over all rows of (x, label).

    Each task sums its rows in numpy; the cells of the sums are added on the
    cluster, and only the moments of two classes come to the driver.
    """
    width = len(shift)
    cells = 1 + width + width * width

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - shift
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                y = x[label == k]
                total[k] += np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
        label, cell = np.divmod(np.arange(2 * cells), cells)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(cell, pa.int32()), pa.array(total.ravel())], ["label", "cell", "v"])

    sums = rows.select("x", "label").mapInArrow(partial, "label int, cell int, v double").groupBy("label", "cell").agg(F.sum("v").alias("v"))
    table = np.zeros((2, cells))
    for r in sums.collect():
        table[r.label, r.cell] = r.v
    return {k: (t[0], t[1 : 1 + width], t[1 + width :].reshape(width, width)) for k, t in enumerate(table) if t[0] > 0}


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, to_pooled: float = 0.05, to_scaled_identity: float = 0.001) -> tuple[Discriminant | None, DataFrame]:
    """The discriminant fitted on all labelled documents that are not held out, and the statistics of all documents."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "quality")
    document_statistics(docs).write.parquet(path)
    x = spark.read.parquet(path)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1)")
    taught = x.filter(~is_held_out(F.col("doc_id"))).join(known, "doc_id")
    return fit(class_moments(taught, np.zeros(len(FEATURES))), to_pooled, to_scaled_identity), x


def scores_of(model: Discriminant | None, x: np.ndarray) -> np.ndarray:
    """Scores of label 1; normal densities overstate how sure they are, asinh keeps far odds apart below 1."""
    odds = model.log_ratio(x) if model else np.zeros(len(x))
    return 1 / (1 + np.exp(-np.arcsinh(odds)))


def score_quality(docs: DataFrame, labels: DataFrame, to_pooled: float = 0.05, to_scaled_identity: float = 0.001) -> DataFrame:
    """One row per document: doc_id, held_out, score (of label 1, 0 to 1), predicted.

    The classes are normal densities over the transformed statistics; their
    covariances shrink towards the pooled one and that towards a multiple of
    the identity.  They are fitted on all labelled documents that are not held
    out; labels, lang, source and doc_id enter no score.

    An empty or null text has statistics like any other.  A null label or
    doc_id teaches nothing; a document with a null doc_id is scored and not
    held out.  Repeated rows count and are returned each.  Without both labels
    every score is 0.5.  Further columns are not read.
    """
    model, x = fit_quality(docs, labels, to_pooled, to_scaled_identity)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores_of(model, rows))], ["doc_id", "score"])

    scored = x.mapInArrow(score, T.StructType([x.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that score at least 0.5; scored where they are read, without a join."""
    model, _ = fit_quality(docs, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", CHUNK):
            scores = scores_of(model, statistics_of(*utf8_buffers(batch.column("text"))))
            yield batch.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(run, docs.schema)
