"""Block-wise alternating least squares against plain loops."""

import numpy as np
import pytest

from brindle.learn import als as module
from brindle.learn.als import als


def brute(rows, rank, rounds, reg, start):
    users, items = sorted({u for u, _, _ in rows}), sorted({i for _, i, _ in rows})
    q = {i: np.full(rank, start) if np.isscalar(start) else start[i] for i in items}
    for _ in range(rounds):
        p = {u: solve([(q[i], r) for v, i, r in rows if v == u], rank, reg) for u in users}
        q = {i: solve([(p[u], r) for u, j, r in rows if j == i], rank, reg) for i in items}
    return p, q


def solve(pairs, rank, reg):
    x, y = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    return np.linalg.solve(x.T @ x + reg * np.eye(rank), x.T @ y)


def ratings(seed, n, users, items):
    """A third of the rows belong to one item."""
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(users)), 3 if k % 3 == 0 else int(rng.integers(items)), float(rng.integers(1, 6))) for k in range(n)]


@pytest.mark.parametrize("unit, rank", [(1_000_000, 1), (40, 1), (40, 3), (7, 2)])
def test_agrees_with_plain_loops(spark, monkeypatch, unit, rank):
    """Whatever the size of the units: a hot item's ratings then lie in many of them."""
    monkeypatch.setattr(module, "UNIT", unit)
    rows = ratings(unit, 150, 20, 15)
    df = spark.createDataFrame([*rows, (None, 1, 2.0), (1, None, 2.0), (1, 2, None)], "user long, item long, rating double").repartition(4)
    p, q = als(df, rank, 2, 0.3, start=1.0 if rank == 1 else None)
    if rank == 1:
        want = brute(rows, 1, 2, 0.3, 1.0)
        for got, truth, key in ((p, want[0], "user"), (q, want[1], "item")):
            found = {r[key]: r.factors for r in got.collect()}
            assert found.keys() == truth.keys() and all(np.allclose(found[k], truth[k]) for k in truth)
    else:
        found_p, found_q = ({r[0]: np.array(r.factors) for r in f.collect()} for f in (p, q))
        again = {i: solve([(found_p[u], r) for u, j, r in rows if j == i], rank, 0.3) for i in found_q}
        assert all(np.allclose(found_q[i], again[i]) for i in again)


def test_recovers_a_low_rank_matrix(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((30, 2)) + 0.5, rng.random((25, 2)) + 0.5
    rows = [(u, i, float(a[u] @ b[i])) for u in range(30) for i in range(25) if (u * 7 + i) % 3]
    p, q = als(spark.createDataFrame(rows, "user int, item int, rating double"), 2, 12, 1e-4)
    fp, fq = ({r[0]: np.array(r.factors) for r in f.collect()} for f in (p, q))
    error = [fp[u] @ fq[i] - a[u] @ b[i] for u in range(30) for i in range(25)]
    assert np.sqrt(np.mean(np.square(error))) < 0.02
    assert dict(p.dtypes)["user"] == "int"


def test_rounds_move_factors_and_no_ratings(spark):
    """The ratings are read while the links are built; a round reads links, needs and factors."""
    df = spark.createDataFrame(ratings(1, 60, 9, 7), "user long, item long, rating double")
    folder = module.scratch_path(spark, "ratings")
    df.write.parquet(folder)
    _, q = als(spark.read.parquet(folder), 1, 1, 0.1, start=1.0)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert folder not in plan and "Join" not in plan


def test_ratings_are_worked_out_once_and_links_stay_where_they_are(spark, monkeypatch):
    """The frame of ratings may be a costly join: its rows are made once, and no round deals links out anew."""
    monkeypatch.setattr(module, "UNIT", 40)
    seen, plans, inner = spark.sparkContext.accumulator(0), [], module._half_round

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def half_round(side, factors, *rest):
        plans.append(side.links.groupBy("block", "part").count()._jdf.queryExecution().executedPlan().toString())
        plans.append(side.needs.groupBy("block").count()._jdf.queryExecution().executedPlan().toString())
        return inner(side, factors, *rest)

    monkeypatch.setattr(module, "_half_round", half_round)
    df = spark.createDataFrame(ratings(4, 200, 30, 20), "user long, item long, rating double").mapInArrow(counted, "user long, item long, rating double")
    users, items = als(df, 1, 1, 0.1, start=1.0)
    assert users.count() <= 30 and items.count() <= 20 and seen.value == 200
    assert len(plans) == 4 and not any("Exchange" in p for p in plans)
