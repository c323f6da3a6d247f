"""Arrow and numpy helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; what a task keeps beside it is a small multiple.
CHUNK_BYTES = 4 << 20

#: Lower-case ASCII letters, digits and bytes of non-ASCII characters stay; all else separates words.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return data.translate(WORD_TABLE).split()


def empty_if_null(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def content_key(*cols: str) -> Column:
    """A 64-bit key of what a row holds, nulls included: rows that repeat get the same one."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols])


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunked(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; a longer text comes alone and whole."""
    for batch in batches:
        sizes = np.asarray(_lengths(batch.column(text)))
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def with_columns_of(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Exactly these columns, a null column where the frame lacks one."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in wanted])


_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers: an invertible mix of shifts and odd multiplications."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _BASE_INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Polynomial sums of the bytes before each position; see :func:`range_hash`."""
    up, _ = POWERS.upto(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_CODES[raw] * up[:-1], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range that depends on the content alone."""
    _, down = POWERS.upto(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])


def word_ranges(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, start and end of every word, and the number of words before each text."""
    folded = np.frombuffer(WORD_TABLE, np.uint8)[raw]
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = folded != 32
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    edge = at[(at > 0) & (at < len(raw))]
    cut = edge[inside[edge] & inside[edge + 1]]
    first[cut] = last[cut] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return folded, starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, at: np.ndarray, piece: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the number of words before each text.

    Long input goes in pieces that are cut between words.
    """
    hashes, low, before = [], 0, np.zeros(len(at), np.int64)
    while low < len(raw):
        high = _cut(raw, at, low + piece)
        inner = np.clip(at, low, high) - low
        folded, starts, ends, words_at = word_ranges(raw[low:high], inner)
        hashes.append(range_hash(prefix_sums(folded), starts, ends))
        before += words_at
        low = high
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), before


def _cut(raw: np.ndarray, at: np.ndarray, near: int) -> int:
    """The first place from ``near`` on that is inside no word."""
    text_end = at[np.searchsorted(at, near)] if near < at[-1] else at[-1]
    while near < text_end:
        separators = np.flatnonzero(np.frombuffer(WORD_TABLE, np.uint8)[raw[near : near + 4096]] == 32)
        if len(separators):
            return min(int(near + separators[0]), int(text_end))
        near += 4096
    return int(text_end)
