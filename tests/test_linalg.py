"""Packed sums, blocks of square matrices, and Lanczos steps against dense solvers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.learn import linalg, packed


def frame(spark, a, parts=5):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(a)], "i long, v array<double>").repartition(parts)


def dense(entries, n):
    out = np.full((n, n), np.nan)
    for r in entries.collect():
        assert np.isnan(out[r.i, r.j])
        out[r.i, r.j] = r.v
    return out


@pytest.mark.parametrize("tasks, fan_in", [(1, 2), (7, 2), (40, 3), (40, 32)])
def test_blocks_are_merged_in_levels(spark, monkeypatch, tasks, fan_in):
    monkeypatch.setattr(packed, "FAN_IN", fan_in)
    rows = spark.range(0, 1000, 1, tasks)

    def partial(batches):
        ids = [i for b in batches for i in b.column("id").to_pylist()]
        return {k: np.array([i for i in ids if i % 3 == k] or [0]).sum(keepdims=True) for k in range(3)}

    got = {r.block: packed.unpack(r.cells).tolist() for r in packed.merged_blocks(rows, partial).collect()}
    assert got == {k: [sum(range(k, 1000, 3))] for k in range(3)}
    total = packed.summed(rows, lambda batches: partial(batches)[0] if tasks < 40 else sum(partial(batches).values()))
    assert total.tolist() == [sum(range(0, 1000, 3)) if tasks < 40 else 499500]


def test_the_shuffle_shrinks_level_by_level(spark):
    """Behind the first level there is one part of a block for each 32 tasks."""
    rows = spark.range(0, 2000, 1, 100)
    out = packed.merged_blocks(rows, lambda batches: {0: np.ones(1) * sum(b.num_rows for b in batches)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and [packed.unpack(r.cells)[0] for r in out.collect()] == [2000.0]


@pytest.mark.parametrize("width, held", [(3, 1 << 20), (7, 8 * 16), (20, 3 * 8 * 16)])
def test_gramian_and_covariance(spark, monkeypatch, width, held):
    """Blocks at the edge, and a triangle that takes several passes."""
    monkeypatch.setattr(linalg, "BLOCK", 4)
    monkeypatch.setattr(linalg, "HELD", held)
    a = np.random.default_rng(width).normal(size=(50, width))
    assert np.allclose(dense(linalg.gramian(frame(spark, a), "v"), width), a.T @ a)
    assert np.allclose(dense(linalg.covariance(frame(spark, a), "v"), width), np.cov(a.T))


def test_covariance_far_from_zero(spark):
    """A mean of 10^9 with a spread of 1 loses nothing: rows are centred before they are multiplied."""
    a = np.random.default_rng(1).normal(size=(200, 4))
    far = (a + 1e9).tolist()
    exact = np.cov((np.array(far) - 1e9).T)
    assert np.abs(dense(linalg.covariance(frame(spark, far), "v"), 4) / exact - 1).max() < 1e-9


@pytest.mark.parametrize("n, k", [(1, 1), (2, 1), (30, 3), (200, 7), (40, 25)])
def test_leading_eigenvectors(n, k):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = np.sort(rng.random(n) ** 3)[::-1] * 50
    square = q * values @ q.T
    products = []
    got, vectors = linalg.leading_eigenvectors(lambda v: products.append(1) or square @ v, n, k)
    assert np.allclose(got, values[:k], rtol=1e-9) and len(products) < max(n + 1, 150)
    assert np.allclose(square @ vectors, vectors * got, atol=1e-6) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-9)


def test_repeated_eigenvalues_and_rank_one():
    square = np.diag([5.0] * 4 + [1.0] * 60)
    got, _ = linalg.leading_eigenvectors(lambda v: square @ v, 64, 4)
    assert np.allclose(got[0], 5.0)
    one = np.outer(np.arange(50.0), np.arange(50.0))
    got, vectors = linalg.leading_eigenvectors(lambda v: one @ v, 50, 3)
    assert np.isclose(got[0], (np.arange(50.0) ** 2).sum()) and np.allclose(got[1:], 0, atol=1e-6)


def test_mode_depends_on_width_and_number():
    assert [linalg.mode_for(n, k) for n, k in ((50, 5), (50, 20), (100, 50), (100, 51), (99, 33), (10_000, 5), (10_000, 9_000))] == [
        "local-eigs", "local-svd", "dist-eigs", "local-svd", "local-svd", "dist-eigs", "dist-eigs",
    ]
    for bad in ((5, 0, "auto"), (5, 6, "auto"), (5, 5, "dist-eigs"), (5, 1, "other")):
        with pytest.raises(ValueError):
            linalg.mode_for(*bad)


@pytest.mark.parametrize("mode", ["auto", "local-svd", "local-eigs", "dist-eigs"])
def test_svd_in_every_mode(spark, mode):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(80, 30)) * np.geomspace(10, 0.1, 30)
    df = frame(spark, a)
    u, s, v = linalg.svd(df, "v", 6, mode=mode)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False)[:6], rtol=1e-8)
    left = np.stack([np.array(r.u) for r in u.orderBy("i").collect()])
    assert np.allclose(left.T @ left, np.eye(6), atol=1e-7) and np.allclose(a @ v, left * s, atol=1e-7)


def test_components_of_a_shifted_matrix(spark):
    a = np.random.default_rng(6).normal(size=(90, 120)) * np.geomspace(9, 0.1, 120) + 1000
    got = linalg.principal_components(frame(spark, a), "v", 3)
    want = np.linalg.eigh(np.cov(a.T))[1][:, ::-1][:, :3]
    assert np.allclose(np.abs((got * want).sum(axis=0)), 1, atol=1e-8)


def test_ten_thousand_columns(spark):
    """Nothing square: 800 MB would not pass; top five values as numpy finds them from the short side."""
    width, rows = 10_000, 300
    base = spark.range(0, rows, 1, 6)
    cell = lambda k: F.pmod(F.xxhash64("id", k), F.lit(1000)) / 1000.0 - 0.5 + F.sin(F.col("id") * (k % 3) / 7.0)
    df = base.select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), cell).alias("v"))
    a = np.array([r.v for r in df.orderBy("id").collect()])
    values, _ = np.linalg.eigh(a @ a.T)
    u, s, v = linalg.svd(df, "v", 5)
    assert v.shape == (width, 5)
    assert np.abs(s / np.sqrt(values[::-1][:5]) - 1).max() < 1e-6
    assert np.allclose(np.linalg.norm(a @ v, axis=0), s, rtol=1e-8)


def test_ragged_and_null_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0])], "i long, v array<double>")
    assert np.allclose(dense(linalg.gramian(df, "v"), 2), [[10, 14], [14, 20]])
    with pytest.raises(ValueError):
        linalg.gramian(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "i long, v array<double>"), "v")
