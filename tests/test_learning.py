"""Learning jobs recover generator parameters; statistics match hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.learn import features as ft
from brindle.learn import linalg, linear, metrics, models, neural, stats


def test_linear_models_recover_weights(spark):
    data = models.linear_data(spark.range(1500), [2.0, -1.0], 0.0, 0.05, seed=3).persist()
    w, losses = linear.train_linear(data, rounds=30, step=0.5)
    assert np.allclose(w, [2, -1], atol=0.05) and losses[-1] < losses[0]
    w, _ = linear.lbfgs(data, linear.least_squares, np.zeros(2), rounds=10)
    assert np.allclose(w, [2, -1], atol=0.02)
    w, _ = linear.train_lasso(data, rounds=20, step=0.5, reg=5.0)
    assert np.allclose(w, 0)
    w, _ = linear.train_ridge(data, rounds=20, step=0.3, reg=1.0)
    assert 0 < abs(w[0]) < 2


def test_classifiers_separate(spark):
    data = models.svm_data(spark.range(1200), [1.0, -1.0], 0.01, seed=1).persist()
    for train in (linear.train_logistic, linear.train_svm):
        w, _ = train(data, rounds=15)
        wrong = data.filter((ft.dot(F.col("features"), ft.literal_vector(w)) > 0).cast("double") != F.col("label")).count()
        assert wrong < 40
    with pytest.raises(ValueError):
        linear.train_svm(data.withColumn("label", F.lit(2.0)), rounds=1)


def test_mean_gradient_of_empty_batch_is_skipped(spark):
    data = models.linear_data(spark.range(10), [1.0])
    w, losses = linear.minibatch_sgd(data.limit(0), linear.least_squares, linear.plain, np.zeros(1), rounds=2)
    assert losses == [] and w[0] == 0


def test_kmeans_finds_centers(spark):
    rows = models.kmeans_data(spark.range(900), 3, 2, spread=50.0, seed=5).persist()
    truth = rows.groupBy("cluster").agg(F.avg(F.col("features")[0]).alias("x")).toPandas().x.sort_values().to_numpy()
    centers, cost = models.kmeans(rows, "features", 3, rounds=10, runs=2, seed=1)
    assert np.allclose(sorted(c[0] for c in centers), truth, atol=0.5)
    assert cost < 900 * 2 * 2


def test_naive_bayes_by_hand(spark):
    data = spark.createDataFrame([(1, 0, "a", 2), (1, 0, "b", 1), (2, 1, "b", 3)], "k int, label int, feature string, weight int")
    priors, thetas = models.naive_bayes(data, "k")
    assert {r.label: r.prior for r in priors.collect()} == pytest.approx({0: math.log(2 / 4), 1: math.log(2 / 4)})
    want = {(0, "a"): 3 / 5, (0, "b"): 2 / 5, (1, "a"): 1 / 5, (1, "b"): 4 / 5}
    assert {(r.label, r.feature): math.exp(r.theta) for r in thetas.collect()} == pytest.approx(want)
    got = models.naive_bayes_scores(data.drop("label"), "k", priors, thetas)
    assert {r.k: r.prediction for r in got.collect()} == {1: 0, 2: 1}


def test_svd_and_pca(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(60, 4)) @ np.diag([5.0, 2.0, 1.0, 0.0])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(a)], "i long, v array<double>")
    u, s, v = linalg.svd(df, "v", 4)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False)[:3], atol=1e-6)
    back = np.stack([np.array(r.u) for r in u.orderBy("i").collect()]) * s @ v.T
    assert np.allclose(back, a, atol=1e-6)
    pc = linalg.principal_components(df, "v", 2)
    want = np.linalg.eigh(np.cov(a.T))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs(pc), np.abs(want), atol=1e-6)
    assert np.allclose(linalg.local_matrix(linalg.covariance(df, "v")), np.cov(a.T))


def test_chi_squared_p_value():
    assert stats.upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.upper_gamma(5, 18.307038053275146 / 2) == pytest.approx(0.05, abs=1e-9)
    assert stats.upper_gamma(1, 0) == 1.0


def test_goodness_of_fit_with_expected(spark):
    df = spark.createDataFrame([(10, 1.0), (20, 1.0), (30, 2.0)], "o long, e double")
    assert tuple(stats.goodness_of_fit(df, "o", "e").first()) == pytest.approx((25 / 15 + 25 / 15, 2))


def test_merged_summaries_equal_whole(spark):
    df = spark.range(100).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    parts = [stats.column_summary(df.filter(F.col("g") == i), ["x"]) for i in range(3)]
    merged = stats.merge_summaries(parts[0].unionAll(parts[1]).unionAll(parts[2])).first()
    whole = stats.column_summary(df, ["x"]).first()
    assert tuple(merged)[1:] == pytest.approx(tuple(whole)[1:])


def test_standard_scaler_constant_column(spark):
    df = spark.createDataFrame([([1.0, 4.0],), ([3.0, 4.0],)], "v array<double>")
    out = sorted(r.scaled for r in ft.standard_scale(df, "v").collect())
    assert out[0] == pytest.approx([-1 / math.sqrt(2), 0]) and out[1] == pytest.approx([1 / math.sqrt(2), 0])


def test_roc_area_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.1, 1)], "s double, l int")
    counts = metrics.threshold_counts(df, "s", "l")
    area = metrics.area_under(metrics.roc_points(counts), (0.0, 0.0), (1.0, 1.0)).first()[0]
    assert area == pytest.approx((1 + 1 + 0 + 0.5 + 1 + 0) / 6)


def test_tree_prediction(spark):
    tree = {"feature": "id", "threshold": 1, "left": {"value": 10.0}, "right": {"feature": "id", "categories": [3], "left": {"value": 20.0}, "right": {"value": 30.0}}}
    assert [r[0] for r in spark.range(4).orderBy("id").select(models.tree_prediction(tree)).collect()] == [10, 10, 30, 20]


def digits(spark, n=400):
    rows = spark.range(n).select((F.col("id") % 2).alias("y"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("u"))
    return rows.select(F.array(F.col("y") * 2 - 1 + F.col("u"), F.col("u")).alias("features"), F.array((F.col("y") == 0).cast("double"), (F.col("y") == 1).cast("double")).alias("target"))


def test_perceptron_gradient_matches_differences():
    rng, shape = np.random.default_rng(1), [3, 4, 2]
    x, y = rng.normal(size=(5, 3)), np.eye(2)[rng.integers(0, 2, 5)]
    w = neural.initial_weights(shape, 2)
    g, _ = neural.block_gradient(x, y, w, shape)
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-6
        slope = (neural.block_gradient(x, y, w + step, shape)[1] - neural.block_gradient(x, y, w - step, shape)[1]) / 2e-6
        assert slope == pytest.approx(g[i], abs=1e-4)


def test_perceptron_learns(spark):
    data = digits(spark).persist()
    flat, losses = neural.train(data, [2, 5, 2], rounds=40, batch=20, adaptive=False, step=2.0)
    assert losses[-1] < losses[0] / 2
    assert neural.error_rate(data, flat, [2, 5, 2]).first()[0] < 0.05


def test_stacking_keeps_every_row(spark):
    out = neural.stack_rows(digits(spark, 130).repartition(3), 32).collect()
    assert sum(r.n for r in out) == 130 and max(r.n for r in out) <= 32
    assert all(len(r.features) == 2 * r.n for r in out)


def test_parameter_table_round_descends(spark):
    data, shape = digits(spark).persist(), [2, 4, 2]
    before = neural.parameter_table(spark, shape, seed=1)
    after = neural.train_through_table(data, shape, rounds=6, rate=2.0, seed=1)
    assert after.count() == before.count() == 4 * 3 + 2 * 5
    losses = []
    for t in (before, after):
        flat = neural._flat_from_table(t, shape)
        x, y = (np.stack(c) for c in zip(*[(r.features, r.target) for r in data.collect()]))
        losses.append(neural.block_gradient(x, y, flat, shape)[1])
    assert losses[1] < losses[0]


def test_adadelta_first_step():
    rule = neural.AdaDelta(1)
    assert rule(np.array([2.0]))[0] == pytest.approx(2 * math.sqrt(1e-8) / math.sqrt(1e-8 + 0.01 * 4))


def test_texts_are_dealt_by_key_before_they_are_cut_into_terms(spark):
    """One shuffle, of the texts; rows of terms are many times longer."""
    rows = [(1, "a b a"), (1, "b c"), (None, "a"), (None, " a\n"), (2, None), (3, "")]
    found = ft.terms(spark.createDataFrame(rows, "k long, x string"), "k", "x")
    assert sorted((r.k or 0, r.term, r.tf) for r in found.collect()) == [(0, "a", 2), (1, "a", 2), (1, "b", 2), (1, "c", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(k") == 1 and "REPARTITION_BY_NUM" in plan
