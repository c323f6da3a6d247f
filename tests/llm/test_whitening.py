import math

import numpy as np
import pytest

from brindle.learn import packed
from brindle.llm import whitening as w
from brindle.llm.queries import QUERIES
from brindle.session import Tables


def brute(vectors, k):
    """x, exact sums, eigenvalues and eigenvectors of the covariance by a dense solver."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(dims)]
    centred = np.array([[(n * r[d] - s[d]) / n for d in range(dims)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:k]
    deviation = [sum((n * r[d] - s[d]) ** 2 for d in range(dims)) for r in x]
    return centred, deviation, values[order], axes[:, order], values.sum()


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>")


def agrees(found, vectors, k, tolerance=1e-9):
    centred, deviation, values, axes, trace = brute(vectors, k)
    found = sorted(found, key=lambda r: r.vec_id)
    assert [r.deviation for r in found] == deviation and {r.n for r in found} == {len(vectors)}
    ours = np.array([r.whitened for r in found])
    theirs = centred @ axes / np.sqrt(values)
    theirs *= np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours - theirs).max() < tolerance
    assert np.abs(np.array(found[0].explained) * trace / values - 1).max() < 1e-10
    assert found[0].identity_error < 1e-9
    cov = np.cov(ours.T, bias=True).reshape(ours.shape[1], -1)
    assert abs(np.abs(cov - np.eye(len(cov))).max() - found[0].identity_error) < 1e-12


@pytest.mark.parametrize("rows, dims, k", [(300, 12, 12), (200, 40, 7), (9, 30, 5), (2, 3, 1)])
def test_agrees_with_a_dense_solver(spark, rows, dims, k):
    rng = np.random.default_rng(rows)
    vectors = rng.standard_normal((rows, dims)) * np.geomspace(30, 1, dims)
    found = w.whiten(frame(spark, vectors, "double").repartition(7), k).collect()
    agrees(found, vectors, k)


def test_sums_in_levels_and_lost_precision(spark, monkeypatch):
    """A mean far above the spread costs no digits, and partial sums go through several levels."""
    monkeypatch.setattr(packed, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((400, 6)) * [9, 7, 5, 3, 2, 1] + 1e9
    agrees(w.whiten(frame(spark, vectors, "double").repartition(9), 4).collect(), vectors, 4)


def test_equal_eigenvalues_are_all_found(spark):
    """Plus and minus unit vectors: every direction has the same variance."""
    vectors = [s * row for row in np.eye(10) * 4 for s in (1, -1)]
    found = w.whiten(frame(spark, vectors), 10).collect()
    assert len(found[0].explained) == 10 and np.allclose(found[0].explained, 0.1) and found[0].identity_error < 1e-12


def test_a_chain_that_stops_early_still_finds_the_largest():
    """Many equal values below a few large ones, and a wide matrix that needs few steps."""
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((600, 400)))
    sizes = np.concatenate([[90, 50, 50, 50, 20], np.full(395, 1.0)])
    x = q * sizes @ np.linalg.qr(rng.standard_normal((400, 400)))[0]
    steps = []

    def product(v, left):
        steps.append(1)
        u = x @ v
        return u @ u, u @ x, u @ (x @ left)

    values, axes = w.Bidiagonalisation(400, product).run(5, 0.0)
    assert np.allclose(values, [90, 50, 50, 50, 20], rtol=1e-12) and len(steps) < 100
    assert np.allclose(np.linalg.norm(x @ axes, axis=0), values) and np.allclose(axes.T @ axes, np.eye(5), atol=1e-12)


def test_rows_that_are_left_out(spark):
    good = [[1.0, 2.0, 3.5], [4.0, -1.0, 0.25], [4.0, -1.0, 0.25], [0.5, 9.0, 2.0]]
    bad = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 1.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    df = frame(spark, good + bad, "double").selectExpr("vec_id", "embedding", "'z' AS n", "1 AS whitened", "2 AS x", "3 AS v")
    found = w.whiten(df, 3).collect()
    assert {r.vec_id for r in found} == {0, 1, 2, 3} and len(found[0].whitened) == 2  # three different points: rank 2
    agrees(found, good, 2)
    null_key = df.selectExpr("CASE WHEN vec_id <> 0 THEN vec_id END AS vec_id", "embedding")
    assert sorted(r.deviation for r in w.whiten(null_key, 3).collect()) == sorted(r.deviation for r in found)


def test_no_spread_and_no_rows(spark):
    same = w.whiten(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert [(r.n, r.deviation, r.whitened) for r in same] == [(3, 0, [])] * 3
    assert w.whiten(frame(spark, [[1.0, 2.0]])).collect()[0].whitened == []
    assert w.whiten(frame(spark, [])).collect() == w.whiten(frame(spark, [None, [math.nan]])).collect() == []


def test_deviations_beyond_a_long(spark):
    found = w.whiten(frame(spark, [[1e9, 0.0], [-1e9, 0.0], [0.0, 0.0], [1.0, 1.0]], "double")).collect()
    far = (4 * 64 * 10**9) ** 2
    assert [r.deviation is None for r in sorted(found, key=lambda r: r.vec_id)] == [far >= 1 << 63] * 2 + [False] * 2


def test_query_agrees_with_a_dense_solver(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op12_golub_kahan_whitening"](spark, sf).collect()
    vectors = [(r.vec_id, r.embedding) for r in Tables(spark, sf).embeddings.collect()]
    centred, deviation, values, axes, trace = brute([v for _, v in vectors], 32)
    at = {k: i for i, (k, _) in enumerate(vectors)}
    assert len(rows) == 32 * len(vectors) and {r.component for r in rows} == set(range(1, 33))
    ours = np.zeros((len(vectors), 32))
    for r in rows:
        ours[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]] and r.n == len(vectors)
        assert abs(r.explained * trace / values[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    theirs = centred @ axes / np.sqrt(values)
    theirs *= np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours - theirs).max() < 1e-8
