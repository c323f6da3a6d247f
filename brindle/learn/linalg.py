"""Distributed matrices: rows as arrays, or (i, j, v) entries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.learn.packed import merged_blocks, summed, unpack
from brindle.operators.grouping import group_lists
from brindle.session import scratch_path

#: Columns and rows of a block of a square matrix.
BLOCK = 256
#: Bytes of blocks that a task adds up at once; a wider matrix takes several passes over the rows.
HELD = 256 << 20
#: Square matrices up to this width may go to the driver.
LOCAL_WIDTH = 4096


def dense_rows(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The arrays of each batch's only column as rows."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class RowMatrix:
    """Rows of equal length, stored once, and what many passes over them need to know."""

    rows: DataFrame
    width: int
    tasks: int

    @classmethod
    def of(cls, df: DataFrame, vector: str) -> RowMatrix:
        """Write the vectors to the scratch folder; null vectors are left out."""
        path = scratch_path(df.sparkSession, "matrix")
        df.select(F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL").write.parquet(path)
        rows = df.sparkSession.read.parquet(path)
        low, high = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
        if low != high:
            raise ValueError("rows differ in length")
        return cls(rows, high or 0, rows.rdd.getNumPartitions())

    def sum_of(self, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of ``f`` over blocks of rows."""
        width = self.width

        def partial(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for x in dense_rows(batches, width):
                total = f(x) if total is None else total + f(x)
            return total

        return summed(self.rows, partial, tasks=self.tasks)

    def means(self) -> tuple[int, np.ndarray]:
        """Number of rows, and the mean of every column about its first value, so that no digits are lost."""
        first = self.rows.first()
        if first is None:
            return 0, np.zeros(self.width)
        base = np.array(first[0])
        total = self.sum_of(lambda x: np.append((x - base).sum(axis=0), len(x)))
        return int(total[-1]), base + total[:-1] / total[-1]

    def gramian_blocks(self, centre: np.ndarray | None = None) -> DataFrame:
        """(block, cells) of the upper triangle of A'A, block i * side + j from row block i and column block j.

        With ``centre``, that is subtracted from the rows first.  Tasks hold
        ``HELD`` bytes of the triangle; a wider one takes a pass for each part.
        """
        side = -(-self.width // BLOCK)
        pairs = [(i, j) for i in range(side) for j in range(i, side)]
        at_once = max(1, HELD // (8 * BLOCK * BLOCK))
        out = None
        for k in range(0, len(pairs), at_once):
            part = merged_blocks(self.rows, self._triangle(pairs[k : k + at_once], side, centre), tasks=self.tasks)
            out = part if out is None else out.unionAll(part)
        return out

    def _triangle(self, pairs: list[tuple[int, int]], side: int, centre: np.ndarray | None) -> Callable:
        width, size = self.width, BLOCK

        def partial(batches: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
            found: dict[int, np.ndarray] = {}
            for x in dense_rows(batches, width):
                x = x if centre is None else x - centre
                for i, j in pairs:
                    got = (x[:, i * size : (i + 1) * size].T @ x[:, j * size : (j + 1) * size]).ravel()
                    found[i * side + j] = found[i * side + j] + got if i * side + j in found else got
            return found

        return partial

    def entries(self, blocks: DataFrame, divisor: float = 1.0) -> DataFrame:
        """Entries (i, j, v) of the whole symmetric matrix from the blocks of its upper triangle."""
        width, side, size = self.width, -(-self.width // BLOCK), BLOCK

        def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, blob in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                    bi, bj = divmod(block, side)
                    rows, columns = (np.arange(b * size, min((b + 1) * size, width)) for b in (bi, bj))
                    v = unpack(blob) / divisor
                    i, j = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
                    sides = [(i, j)] if bi == bj else [(i, j), (j, i)]
                    for a, b in sides:
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(v)], ["i", "j", "v"])

        return blocks.mapInArrow(spread, "i int, j int, v double")

    def local_square(self, blocks: DataFrame) -> np.ndarray:
        """The symmetric matrix on the driver, up to ``LOCAL_WIDTH`` columns."""
        if self.width > LOCAL_WIDTH:
            raise ValueError("matrix too wide for the driver")
        side = -(-self.width // BLOCK)
        out = np.zeros((self.width, self.width))
        for row in blocks.collect():
            i, j = (b * BLOCK for b in divmod(row.block, side))
            part = out[i : i + BLOCK, j : j + BLOCK]
            part[:] = unpack(row.cells).reshape(part.shape)
            out[j : j + BLOCK, i : i + BLOCK] = part.T
        return out

    def gramian_times(self, centre: np.ndarray | None = None) -> Callable[[np.ndarray], np.ndarray]:
        """v to A'(Av), one pass over the rows; nothing square anywhere."""

        def times(v: np.ndarray) -> np.ndarray:
            def f(x: np.ndarray) -> np.ndarray:
                x = x if centre is None else x - centre
                return (x @ v) @ x

            return self.sum_of(f)

        return times


def gramian(df: DataFrame, vector: str) -> DataFrame:
    """A'A as entries (i, j, v)."""
    matrix = RowMatrix.of(df, vector)
    return matrix.entries(matrix.gramian_blocks())


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """Sample covariance as entries (i, j, v); rows are centred before they are multiplied."""
    matrix = RowMatrix.of(df, vector)
    n, means = matrix.means()
    return matrix.entries(matrix.gramian_blocks(means), n - 1)


def leading_eigenvectors(
    times: Callable[[np.ndarray], np.ndarray], n: int, k: int, tolerance: float = 1e-10, most: int | None = None, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors of a symmetric operator, by Lanczos steps.

    At most max(2 k, 20) vectors are kept: when they are used up, the best Ritz
    vectors and the last residual begin the next sweep.  Every vector is
    orthogonalised twice against all others.  After ``most`` products (300 or
    3 k by default) only converged pairs are returned.
    """
    room = min(max(2 * k, 20), n)
    most = most or max(300, 3 * k)
    rng = np.random.default_rng(seed)
    basis = np.zeros((n, room + 1))
    small = np.zeros((room, room))

    def off_basis(w: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
        part = np.zeros(upto)
        for _ in range(2):
            h = basis[:, :upto].T @ w
            w, part = w - basis[:, :upto] @ h, part + h
        return w, part

    start = rng.standard_normal(n)
    basis[:, 0] = start / np.linalg.norm(start)
    kept, products = 0, 0
    while True:
        for j in range(kept, room):
            w, part = off_basis(times(basis[:, j]), j + 1)
            products += 1
            small[: j + 1, j] = small[j, : j + 1] = part
            beta = float(np.linalg.norm(w))
            if beta <= 1e-13 * max(np.abs(part).max(), np.finfo(float).tiny):
                # The space is closed under the operator: go on in a new direction, if there is one.
                beta = 0.0
                if j + 1 < n:
                    w, _ = off_basis(rng.standard_normal(n), j + 1)
            length = np.linalg.norm(w)
            basis[:, j + 1] = w / length if length else 0.0
        values, vectors = np.linalg.eigh(small)
        values, vectors = values[::-1], vectors[:, ::-1]
        good = beta * np.abs(vectors[-1]) <= tolerance * np.maximum(np.abs(values), np.finfo(float).eps ** (2 / 3))
        if room == n or good[:k].all() or products >= most:
            which = np.flatnonzero(good[:k]) if room < n else np.arange(k)
            return values[which], basis[:, :room] @ vectors[:, which]
        kept = min(k + max(1, (room - k) // 2), room - 1)
        basis[:, :kept] = basis[:, :room] @ vectors[:, :kept]
        basis[:, kept] = basis[:, room]
        small[:] = 0.0
        small[np.arange(kept), np.arange(kept)] = values[:kept]


#: How the leading eigenvectors of A'A are found.
MODES = ("auto", "local-svd", "local-eigs", "dist-eigs")


def mode_for(width: int, k: int, mode: str = "auto") -> str:
    """The square matrix on the driver for narrow matrices or many vectors, products with the rows otherwise."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if not 0 < k <= width:
        raise ValueError(f"k must be 1 to {width}")
    if mode == "auto":
        local = width < 100 or k > width / 2
        mode = "dist-eigs" if not local or width > LOCAL_WIDTH else "local-eigs" if k < width / 3 else "local-svd"
    if mode != "local-svd" and k == width and width > 1:
        raise ValueError(f"k must be below {width} in this mode")
    return mode


def _leading(matrix: RowMatrix, k: int, mode: str, centre: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    mode = mode_for(matrix.width, k, mode)
    if mode == "dist-eigs":
        return leading_eigenvectors(matrix.gramian_times(centre), matrix.width, k)
    square = matrix.local_square(matrix.gramian_blocks(centre))
    if mode == "local-eigs":
        return leading_eigenvectors(lambda v: square @ v, matrix.width, k)
    values, vectors = np.linalg.eigh(square)
    return values[::-1][:k], vectors[:, ::-1][:, :k]


def principal_components(df: DataFrame, vector: str, k: int, mode: str = "auto") -> np.ndarray:
    """Columns are the k leading eigenvectors of the covariance."""
    matrix = RowMatrix.of(df, vector)
    return _leading(matrix, k, mode, matrix.means()[1])[1]


def multiply(df: DataFrame, vector: str, matrix: np.ndarray, out: str = "product") -> DataFrame:
    """Rows times a local matrix, which travels as a broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(matrix, dtype="float64"))

    @F.pandas_udf("array<double>")
    def times(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()).astype("float64") @ shared.value))

    return df.withColumn(out, times(vector))


def svd(df: DataFrame, vector: str, k: int, tolerance: float = 1e-9, mode: str = "auto") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows with column ``u``, singular values, right vectors); U = A V / s on the executors.

    Singular values below ``tolerance`` times the largest count as zero and are
    left out.  The driver holds as many numbers as A has columns, some 2 k
    times; in the local modes also the square matrix A'A.
    """
    values, v = _leading(RowMatrix.of(df, vector), k, mode, None)
    s = np.sqrt(np.maximum(values, 0))
    kept = s > tolerance * max(s.max(initial=0.0), 1e-300)
    s, v = s[kept], v[:, kept]
    return multiply(df, vector, v / s, "u"), s, v


def local_matrix(entries: DataFrame) -> np.ndarray:
    """Entries of a small square matrix on the driver (at most ``LOCAL_WIDTH`` columns)."""
    rows = entries.toPandas()
    size = int(rows.i.max()) + 1
    if size > LOCAL_WIDTH:
        raise ValueError("matrix too large for the driver")
    out = np.zeros((size, size))
    out[rows.i, rows.j] = rows.v
    return out


def entries_to_rows(entries: DataFrame) -> DataFrame:
    """(i, j, v) to (i, chunk, cells); a very long sparse row comes in several chunks."""
    return group_lists(entries, "i", F.struct("j", "v"), "cells")
