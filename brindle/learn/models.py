"""Naive Bayes, k-means steps, tree predictions, factor models, data generators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.learn.features import dot, literal_vector
from brindle.learn.linear import MAX_WEIGHTS
from brindle.operators.relational import attach_row, bounded_cross, hot_keys, salted_join
from brindle.session import cut_lineage


def naive_bayes(rows: DataFrame, key: str, smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Multinomial model from long rows (key, label, feature, weight).

    Returns (label, prior) and (label, feature, theta), all logarithms.
    """
    docs = rows.select(key, "label").distinct().groupBy("label").agg(F.count("*").alias("n"))
    n_all = docs.agg(F.sum("n").alias("total"), F.count("*").alias("labels"))
    prior = F.log((F.col("n") + smoothing) / (F.col("total") + smoothing * F.col("labels")))
    priors = attach_row(docs, n_all).select("label", prior.alias("prior"))
    sums = rows.groupBy("label", "feature").agg(F.sum("weight").alias("w"))
    features = sums.select("feature").distinct()
    count = features.agg(F.count("*").alias("features"))
    totals = sums.groupBy("label").agg(F.sum("w").alias("total"))
    theta = F.log((F.coalesce("w", F.lit(0.0)) + smoothing) / (F.col("total") + smoothing * F.col("features")))
    # every label with every feature: the size of the model itself; the labels are few, and counted
    grid = bounded_cross(features, attach_row(totals, count), 10_000)
    thetas = grid.join(sums, ["label", "feature"], "left").select("label", "feature", theta.alias("theta"))
    return priors, thetas


def naive_bayes_scores(rows: DataFrame, key: str, priors: DataFrame, thetas: DataFrame) -> DataFrame:
    """Rows (key, prediction): the label of the highest score, the smallest label of ties."""
    parts = rows.join(thetas.withColumnRenamed("label", "__l"), "feature").groupBy(key, "__l").agg(F.sum(F.col("weight") * F.col("theta")).alias("s"))
    scored = parts.join(priors.withColumnRenamed("label", "__l"), "__l").withColumn("s", F.round(F.col("s") + F.col("prior"), 9))
    return scored.groupBy(key).agg(F.min(F.struct((-F.col("s")).alias("m"), F.col("__l").alias("l")))["l"].alias("prediction"))


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the closest center of each row; the lowest index of ties."""
    best, cost = np.zeros(len(x), dtype="int32"), np.full(len(x), np.inf)
    for i, c in enumerate(centers):
        d = ((x - c) ** 2).sum(axis=1)
        closer = d < cost
        best[closer], cost[closer] = i, d[closer]
    return best, cost


def _shared_centers(df: DataFrame, centers: np.ndarray):
    centers = np.asarray(centers, dtype="float64")
    if centers.size > MAX_WEIGHTS:
        raise ValueError("too many centers to broadcast")
    return df.sparkSession.sparkContext.broadcast(centers)


def assign_clusters(df: DataFrame, vector: str, centers: np.ndarray) -> DataFrame:
    """Add ``cluster`` and ``cost`` (squared distance); the centers travel as a broadcast."""
    shared = _shared_centers(df, centers)

    @F.pandas_udf("cluster int, cost double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        cluster, cost = _nearest(np.stack(v.to_numpy()), shared.value)
        return pd.DataFrame({"cluster": cluster, "cost": cost})

    return df.withColumn("__best", nearest(vector)).withColumns({"cluster": F.col("__best.cluster"), "cost": F.col("__best.cost")}).drop("__best")


def kmeans_step(df: DataFrame, vector: str, centers: np.ndarray) -> np.ndarray:
    """New centers: sums per partition, then per cluster and place on the cluster; empty clusters stay."""
    shared = _shared_centers(df, centers)

    def partial(batches):
        sums, sizes = np.zeros_like(shared.value), np.zeros(len(shared.value))
        for rows in batches:
            if len(rows):
                x = np.stack(rows[vector].to_numpy())
                cluster, _ = _nearest(x, shared.value)
                np.add.at(sums, cluster, x)
                sizes += np.bincount(cluster, minlength=len(sizes))
        c, i = np.indices(sums.shape)
        yield pd.DataFrame({"c": c.ravel(), "i": i.ravel(), "s": sums.ravel(), "n": sizes[c.ravel()]})

    parts = df.select(vector).mapInPandas(partial, "c int, i int, s double, n double")
    means = parts.groupBy("c", "i").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m")).dropna().toPandas()
    new = np.array(centers, dtype="float64")
    new[means.c, means.i] = means.m
    return new


def kmeans_parallel_start(df: DataFrame, vector: str, k: int, rounds: int = 3, seed: int = 0) -> np.ndarray:
    """Start centers by distance-weighted sampling in a few rounds, then weighted reduction to k.

    A round draws 2 k rows on average, whatever the size of the frame, and all that are drawn are kept.
    """
    first = df.orderBy(F.rand(seed)).select(vector).first()[0]
    centers = np.array([first], dtype="float64")
    for r in range(rounds):
        costed = assign_clusters(df, vector, centers)
        total = costed.agg(F.sum("cost")).first()[0]
        if not total:
            break
        chance = F.col("cost") * (2 * k) / total
        picked = costed.filter(F.rand(seed + r + 1) < chance).select(vector).toPandas()
        if len(picked):
            centers = np.vstack([centers, np.stack(picked[vector].to_numpy())])
    sizes = assign_clusters(df, vector, centers).groupBy("cluster").count().toPandas()
    weight = np.zeros(len(centers))
    weight[sizes.cluster] = sizes["count"]
    rng = np.random.default_rng(seed)
    chosen = [int(np.argmax(weight))]
    while len(chosen) < min(k, len(centers)):
        d = ((centers[:, None] - centers[chosen][None]) ** 2).sum(axis=2).min(axis=1) * weight
        if d.sum() == 0:
            break
        chosen.append(int(rng.choice(len(centers), p=d / d.sum())))
    return centers[chosen]


def kmeans(df: DataFrame, vector: str, k: int, rounds: int = 10, runs: int = 1, seed: int = 0, start: str = "parallel", tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Best of several runs: (centers, cost)."""
    best = None
    for run in range(runs):
        if start == "random":
            picked = df.orderBy(F.rand(seed + 1000 * run)).select(vector).limit(k).toPandas()
            centers = np.stack(picked[vector].to_numpy())
        else:
            centers = kmeans_parallel_start(df, vector, k, seed=seed + 1000 * run)
        for _ in range(rounds):
            new = kmeans_step(df, vector, centers)
            moved = np.abs(new - centers).max()
            centers = new
            if moved < tolerance:
                break
        cost = assign_clusters(df, vector, centers).agg(F.sum("cost")).first()[0]
        if best is None or cost < best[1]:
            best = (centers, cost)
    return best


def tree_prediction(node: dict) -> Column:
    """Nested when-expression of a tree: inner nodes {feature, threshold | categories, left, right}, leaves {value}."""
    if "value" in node:
        return F.lit(node["value"])
    c = F.col(node["feature"])
    goes_left = c.isin(list(node["categories"])) if "categories" in node else c <= node["threshold"]
    return F.when(goes_left, tree_prediction(node["left"])).otherwise(tree_prediction(node["right"]))


def impurities(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Per group: gini and entropy of the label's classes, variance of its value."""
    classes = df.groupBy(*keys, label).agg(F.count("*").alias("c"))
    n = F.sum("c")
    sum_clogc = F.sum(F.col("c") * F.log2("c"))
    mean = F.sum(F.col("c") * F.col(label)) / n
    return classes.groupBy(*keys).agg(
        (1 - F.sum(F.col("c") * F.col("c")) / (n * n)).alias("gini"),
        (F.log2(n) - sum_clogc / n).alias("entropy"),
        (F.sum(F.col("c") * F.col(label) * F.col(label)) / n - mean * mean).alias("variance"),
    )


def split_candidates(df: DataFrame, features: list[str], bins: int, fraction: float, seed: int = 0) -> DataFrame:
    """Rows (feature, splits): sampled quantiles that cut a feature into ``bins`` bins."""
    probabilities = [i / bins for i in range(1, bins)]
    sample = df.sample(False, fraction, seed)
    parts = [F.struct(F.lit(f).alias("feature"), F.array_distinct(F.percentile_approx(f, probabilities)).alias("splits")) for f in features]
    return sample.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def predict_ratings(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Dot products of (user, item) pairs with factor frames (user, uf) and (item, pf); unknown ids drop out."""
    pairs = cut_lineage(pairs)  # counted for hot users and items, then joined
    hot_items = hot_keys(pairs, ["item"])
    joined = salted_join(salted_join(pairs, users, ["user"]), items, ["item"], hot=hot_items)
    return joined.select("user", "item", dot(F.col("uf"), F.col("pf")).alias("rating"))


def top_matches(factors: DataFrame, key: str, vector: str, wanted: list[float], k: int) -> DataFrame:
    """The k rows whose factors have the largest dot product with ``wanted``; a bounded sort, no cross product."""
    scored = factors.select(key, dot(F.col(vector), literal_vector(wanted)).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


# --- data generators: one row per input row, seeded by its id ---------------------------------------


def _normal(seed: int, salt: int, *cols) -> Column:
    def unit(s):
        return (F.pmod(F.xxhash64(*cols, F.lit(seed), F.lit(s)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)

    return F.sqrt(-2 * F.log(unit(2 * salt))) * F.cos(2 * F.pi() * unit(2 * salt + 1))


def _normals(seed: int, width: int) -> Column:
    return F.array(*[_normal(seed, i, F.col("id")) for i in range(width)])


def linear_data(ids: DataFrame, weights: list[float], intercept: float = 0.0, noise: float = 0.1, seed: int = 0) -> DataFrame:
    x = _normals(seed, len(weights))
    y = dot(F.col("features"), literal_vector(weights)) + intercept + noise * _normal(seed, 999, F.col("id"))
    return ids.select("id", x.alias("features")).withColumn("label", y)


def logistic_data(ids: DataFrame, width: int = 2, shift: float = 3.0, positive: float = 0.5, seed: int = 0) -> DataFrame:
    label = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) < positive * 1000).cast("double")
    x = F.transform(_normals(seed, width), lambda v: v + F.when(F.col("label") == 1, shift).otherwise(0.0))
    return ids.select("id", label.alias("label")).withColumn("features", x)


def svm_data(ids: DataFrame, weights: list[float], noise: float = 0.1, seed: int = 0) -> DataFrame:
    rows = linear_data(ids, weights, 0.0, noise, seed)
    return rows.withColumn("label", (F.col("label") > 0).cast("double"))


def kmeans_data(ids: DataFrame, k: int, width: int, spread: float = 10.0, seed: int = 0) -> DataFrame:
    center = np.random.default_rng(seed).normal(0, spread, (k, width))
    table = F.array(*[literal_vector(c) for c in center])
    rows = ids.withColumn("cluster", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)).cast("int"))
    x = F.zip_with(F.get(table, F.col("cluster")), _normals(seed + 1, width), lambda c, e: c + e)
    return rows.withColumn("features", x)


def factor_data(cells: DataFrame, rank: int = 3, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Ratings of (user, item) cells from random factors of both."""
    u = F.array(*[_normal(seed, i, F.col("user")) for i in range(rank)])
    p = F.array(*[_normal(seed, 100 + i, F.col("item")) for i in range(rank)])
    return cells.select("user", "item", (dot(u, p) / rank**0.5 + noise * _normal(seed, 777, F.col("user"), F.col("item"))).alias("rating"))
