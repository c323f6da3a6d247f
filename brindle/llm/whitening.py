"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Steps alternate between products of the centred rows X with a right vector v
and of their transpose with a left vector u.  Every new vector is
orthogonalised against all earlier ones of its side.  The right vectors are as
long as a row and stay with the driver.  A left vector is as long as the table
and is never kept: it is X y for a short vector y, and tasks form it anew from
the rows, so that an executor can be lost at any time.  The singular values and
right vectors of the small bidiagonal matrix give the principal components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.learn.packed import summed
from brindle.session import scratch_path

COMPONENTS = 32
#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: A triplet is done when its residual, as a part of the largest singular value, is below this.
CONVERGED = 1e-14
#: A direction has no length, as a part of the largest singular value, below this.
NOTHING = 1e-11
MOST = float(1 << 62)


def fixed_point(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET).cast("long"))


def usable(vector: Column) -> Column:
    """No null, no entry that is null or not finite, none whose fixed-point form is no long."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < MOST, F.lit(False)))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def rows_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _carried(halves: np.ndarray) -> np.ndarray:
    """Low and high halves of long sums, the low ones below 2^32 again."""
    low, high = halves.reshape(2, -1)
    return np.concatenate([low & 0xFFFFFFFF, high + (low >> 32)])


@dataclass
class Fit:
    """Count, exact sums and mean of the rows, and what the bidiagonalisation has found."""

    n: int
    sums: list[int]
    #: The mean: a whole part, and the rest of it.
    whole: np.ndarray
    rest: np.ndarray
    trace: float
    components: np.ndarray
    eigenvalues: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exactly; None where it is no long."""
        away = np.abs(self.centred(x)).max(axis=1, initial=0.0) * self.n
        near = (away + self.n + 1) ** 2 * x.shape[1] < MOST
        out: list[int | None] = [None] * len(x)
        if near.any():
            # n * x - S = n * (x - whole) - (S - n * whole): both parts are small where the result is.
            left = np.array([s - self.n * int(w) for s, w in zip(self.sums, self.whole.tolist(), strict=True)], np.int64)
            t = (x[near] - self.whole) * self.n - left
            for i, v in zip(np.flatnonzero(near).tolist(), (t * t).sum(axis=1).tolist(), strict=True):
                out[i] = v
        for i in np.flatnonzero(~near).tolist():
            v = sum((self.n * int(c) - s) ** 2 for c, s in zip(x[i].tolist(), self.sums, strict=True))
            out[i] = v if v < 1 << 63 else None
        return out


class Bidiagonalisation:
    """The state of the iteration: right vectors V, left vectors as X Y, X'U, and the matrix R with X V = U R."""

    def __init__(self, dims: int, product: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]]):
        self.dims, self.product = dims, product
        self.right = np.zeros((dims, 0))
        self.left = np.zeros((dims, 0))
        self.back = np.zeros((dims, 0))
        self.matrix = np.zeros((0, 0))
        self.random = np.random.default_rng(20)

    def _away_from(self, v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - self.right @ (self.right.T @ v)
        return v

    def _fresh(self) -> np.ndarray:
        v = self._away_from(self.random.standard_normal(self.dims))
        return v / np.linalg.norm(v)

    @property
    def largest(self) -> float:
        return float(np.linalg.norm(self.matrix, 2)) if self.matrix.size else 0.0

    def step(self, v: np.ndarray, beta: float) -> float:
        """Take in the right vector ``v``, linked by ``beta`` to the last left one; gives the length of the new left one."""
        k = self.left.shape[1]
        q = v - beta * self.left[:, -1] if beta else v
        square, transposed, inner = self.product(q, self.left)
        column = inner.copy()
        if beta:
            column[-1] += beta
        alpha = float(np.sqrt(max(square - inner @ inner, 0.0)))
        self.right = np.column_stack([self.right, v])
        grown = np.zeros((k + 1, self.right.shape[1]))
        grown[:k, :-1] = self.matrix
        grown[:k, -1] = column
        if alpha <= NOTHING * max(self.largest, alpha, np.finfo(float).tiny):
            self.matrix = grown[:k]
            return 0.0
        grown[k, -1] = alpha
        self.matrix = grown
        self.left = np.column_stack([self.left, (q - self.left @ inner) / alpha])
        self.back = np.column_stack([self.back, (transposed - self.back @ inner) / alpha])
        return alpha

    def run(self, wanted: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Largest singular values and their right vectors.

        A chain that has converged finds one of several equal values only.  So a
        new chain starts from a random direction off all right vectors; the end
        is when it changes nothing, or when there is no direction left.
        """
        before: np.ndarray | None = None
        while self.right.shape[1] < self.dims:
            alpha = self.step(v := self._fresh(), 0.0)
            if alpha <= max(NOTHING * self.largest, floor):
                break
            while self.right.shape[1] < self.dims:
                r = self._away_from(self.back[:, -1] - alpha * v)
                beta = float(np.linalg.norm(r))
                p, s, _ = np.linalg.svd(self.matrix, full_matrices=False)
                top = min(wanted, len(s))
                if beta <= NOTHING * s[0] or len(s) >= wanted and (beta * np.abs(p[-1, :top])).max() <= CONVERGED * s[0]:
                    break
                alpha = self.step(v := r / beta, beta)
                if not alpha:
                    break
            s = np.linalg.svd(self.matrix, compute_uv=False)[:wanted]
            if len(s) == wanted and before is not None and np.abs(s - before).max() <= 1e-13 * s[0]:
                break
            before = s if len(s) == wanted else None
        if not self.matrix.size:
            return np.empty(0), np.empty((self.dims, 0))
        _, s, t = np.linalg.svd(self.matrix, full_matrices=False)
        some = s[:wanted] > max(NOTHING * s[0], floor)
        return s[:wanted][some], (self.right @ t[:wanted].T)[:, some]


def fit(points: DataFrame, dims: int, tasks: int, wanted: int) -> Fit | None:
    """Principal components of all rows of ``points(x array<long>)``; None without rows."""

    def totals(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for batch in batches:
            x = rows_of(batch, dims)
            got = np.concatenate([[len(x)], (x & 0xFFFFFFFF).sum(axis=0), [0], (x >> 32).sum(axis=0)])
            out = _carried(got if out is None else out + got)
        return out

    exact = summed(points, totals, lambda a, b: _carried(a + b), tasks)
    if exact is None or not exact[0]:
        return None
    low, high = (half.tolist() for half in exact.reshape(2, -1))
    n, *sums = [a + (b << 32) for a, b in zip(low, high, strict=True)]
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    found = Fit(n, sums, whole, rest, 0.0, np.empty((dims, 0)), np.empty(0))

    def total(of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def partial(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
            out = None
            for batch in batches:
                got = of(found.centred(rows_of(batch, dims)))
                out = got if out is None else out + got
            return out

        return summed(points, partial, tasks=tasks)

    first = total(lambda c: np.concatenate([c.sum(axis=0), (c * c).sum(axis=0)]))
    found.rest = found.rest + first[:dims] / n
    found.trace = float(first[dims:].sum()) / n

    def product(q: np.ndarray, left: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """For w = X q: w'w, X'w, U'w with U = X Y."""

        def of(c: np.ndarray) -> np.ndarray:
            w = c @ q
            return np.concatenate([[w @ w], w @ c, w @ (c @ left)])

        got = total(of)
        return float(got[0]), got[1 : dims + 1], got[dims + 1 :]

    # Rounding of the mean alone gives rows that are all equal a length of about this.
    floor = 1e-9 * float(np.sqrt(n))
    values, found.components = Bidiagonalisation(dims, product).run(min(wanted, dims), floor)
    found.eigenvalues = values**2 / n
    if len(values):
        sign = np.sign(found.components[np.abs(found.components).argmax(axis=0), np.arange(len(values))])
        found.components = found.components * sign
        scaled = found.components / np.sqrt(found.eigenvalues)
        second = total(lambda c: ((w := c @ scaled).T @ w).ravel()).reshape(len(values), -1) / n
        found.identity_error = float(np.abs(second - np.eye(len(values))).max())
    return found


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per vector: key, n, deviation, whitened, explained, identity_error.

    ``whitened`` has the projections of x - S / n on up to ``components``
    principal components, each over its deviation; ``explained`` is the
    components' parts of the whole variance; the components fall by eigenvalue,
    and the largest entry of each is positive.  x is the vector in fixed point,
    S the sum of all x, ``deviation`` the sum of (n x - S)^2.

    A vector that is null or empty, that holds a null or an entry that is not
    finite or 2^56 or more, or whose length is not the most frequent one (of
    several, the longest), gives no row and is not counted.  A null key stays
    null; rows that repeat count and come each time.  Rows of rank r have r
    components: none if all vectors are equal or there is only one.
    ``deviation`` is null where it is no long.  An empty table gives no rows.
    Further columns are not read.
    """
    spark, folder = embeddings.sparkSession, scratch_path(embeddings.sparkSession, "whiten")
    out = T.StructType(
        [embeddings.schema[key], T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
        + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("whitened", "explained")]
        + [T.StructField("identity_error", T.DoubleType())]
    )
    rows = embeddings.select(key, F.col(vector).alias("v")).filter(usable(F.col("v")))
    length = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if length is None:
        return spark.createDataFrame([], out)
    dims = length.dims
    rows.filter(F.size("v") == dims).select(key, fixed_point(F.col("v")).alias("x")).write.parquet(folder)
    points = spark.read.parquet(folder)
    xs = points.select("x")
    found = fit(xs, dims, xs.rdd.getNumPartitions(), components)
    r = len(found.eigenvalues)
    explained = (found.eigenvalues / found.trace).tolist() if r else []

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch, dims)
            w = found.whitened(x) if r else np.empty((len(x), 0))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * r)
            arrays = [
                batch.column(0),
                pa.array(np.full(len(x), found.n)),
                pa.array(found.deviation(x), pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(w.ravel(), pa.float64())),
                pa.ListArray.from_arrays(ends, pa.array(explained * len(x), pa.float64())),
                pa.array(np.full(len(x), found.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, out.names)

    return points.select(key, "x").mapInArrow(project, out)
