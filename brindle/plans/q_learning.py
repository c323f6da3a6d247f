"""Statistics, features, learning and metrics over the tables."""

import numpy as np
from pyspark.sql import functions as F

from brindle.learn import features as ft
from brindle.learn.als import als
from brindle.learn import linalg, linear, metrics, models, neural, stats
from brindle.operators.relational import union_all_of
from brindle.registry import query

WIDTH = 64  # length of every embedding
VEC = ft.doubles


def _n():
    return F.count("*").alias("n")


def _rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _vectors(t):
    return t.embeddings.select("vec_id", "label", VEC("embedding").alias("features"))


# --- statistics -----------------------------------------------------------------------------


def _summary_sql(col, table="lineitem", where=""):
    return f"""SELECT '{col}' AS "column", COUNT({col}) AS n, round(AVG({col}), 6) AS mean, round(var_samp({col}), 4) AS variance,
        SUM(({col} <> 0)::INTEGER)::BIGINT AS nonzeros, MAX({col})::DOUBLE AS max, MIN({col})::DOUBLE AS min FROM {table} {where}"""


_COLS = ["l_quantity", "l_discount", "l_tax"]


@query("q1_column_summary", " UNION ALL ".join(_summary_sql(c) for c in _COLS))
def q1(t):
    return _rounded(_rounded(stats.column_summary(t.lineitem, _COLS), 6, "mean"), 4, "variance")


@query("q2_pearson", "SELECT round(corr(p_size, p_retailprice), 9) AS r FROM part")
def q2(t):
    return t.part.agg(F.round(F.corr("p_size", "p_retailprice"), 9).alias("r"))


def _corr_sql(cols, table):
    def one(a, b):
        if a == b:
            return f"SELECT '{a}' AS a, '{b}' AS b, 1.0::DOUBLE AS corr"
        return f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM {table}"

    return " UNION ALL ".join(one(a, b) for a in cols for b in cols)


@query("q3_correlation_matrix", _corr_sql(_COLS, "lineitem"))
def q3(t):
    return _rounded(stats.correlation_matrix(t.lineitem, _COLS), 6, "corr")


_RANKED = "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in ("p_size", "p_retailprice")) + " FROM part) x"


@query("q3_spearman_matrix", _corr_sql(["p_size", "p_retailprice"], _RANKED))
def q3_spearman(t):
    return _rounded(stats.correlation_matrix(t.part, ["p_size", "p_retailprice"], "spearman"), 6, "corr")


@query(
    "q4_goodness_of_fit",
    """SELECT round(SUM(power(n - e, 2) / e), 6) AS statistic, COUNT(*) - 1 AS freedom FROM
       (SELECT n, SUM(n) OVER () / COUNT(*) OVER () AS e FROM (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1) c) x""",
)
def q4(t):
    return _rounded(stats.goodness_of_fit(t.events.groupBy("event_type").agg(_n()), "n"), 6, "statistic")


@query("q4_goodness_of_fit_p_value")
def q4_p(t):
    fit = stats.goodness_of_fit(t.events.groupBy("event_type").agg(_n()), "n")
    return fit.withColumn("p", stats.chi_squared_p(F.col("statistic"), F.col("freedom")))


def _chi_sql(a, b, table):
    return f"""SELECT round(SUM(power(coalesce(o, 0) - ra * cb / t, 2) / (ra * cb / t)), 6) AS statistic,
        (COUNT(DISTINCT a) - 1) * (COUNT(DISTINCT b) - 1) AS freedom FROM
        (SELECT {a} AS a, COUNT(*)::DOUBLE AS ra FROM {table} GROUP BY 1) CROSS JOIN (SELECT {b} AS b, COUNT(*)::DOUBLE AS cb FROM {table} GROUP BY 1)
        CROSS JOIN (SELECT COUNT(*)::DOUBLE AS t FROM {table}) LEFT JOIN (SELECT {a} AS a, {b} AS b, COUNT(*)::DOUBLE AS o FROM {table} GROUP BY 1, 2) USING (a, b)"""


@query("q5_independence", _chi_sql("l_returnflag", "l_linenumber", "lineitem"))
def q5(t):
    return _rounded(stats.independence(t.lineitem, "l_returnflag", "l_linenumber"), 6, "statistic")


@query(
    "q6_feature_independence",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, * FROM ({_chi_sql(f, 'p_type', 'part')})" for f in ("p_size", "p_brand")),
)
def q6(t):
    return _rounded(stats.features_independence(t.part, ["p_size", "p_brand"], "p_type"), 6, "statistic")


@query("q7_random_tables")
def q7(t):
    """One uniform, one normal and one Poisson number, and a normal vector, per part."""
    import pandas as pd

    @F.pandas_udf("int")
    def poisson(seed: pd.Series) -> pd.Series:
        return pd.Series(np.random.default_rng(int(seed.iloc[0])).poisson(3.0, len(seed)).astype("int32"))

    rows = t.part.select("p_partkey", F.rand(1).alias("u"), F.randn(2).alias("g"), poisson("p_partkey").alias("p"))
    return rows.withColumn("v", F.array(*[F.randn(10 + i) for i in range(3)]))


@query("q8_random_from_generator")
def q8(t):
    def gamma(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([8, TaskContext.get().partitionId()])
        for rows in batches:
            yield rows.assign(x=rng.gamma(2.0, 1.5, len(rows)))

    return t.orders.select("o_orderkey").mapInPandas(gamma, "o_orderkey long, x double")


# --- text features ----------------------------------------------------------------------------

_TF = r"(SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \n\t]+')) AS term FROM documents) x WHERE term <> '' GROUP BY 1, 2)"
_IDF = f"(SELECT term, COUNT(*) AS df, ln((SELECT COUNT(DISTINCT doc_id) + 1.0 FROM {_TF}) / (COUNT(*) + 1)) AS idf FROM {_TF} GROUP BY 1)"


def _tf(t):
    return ft.terms(t.documents, "doc_id", "text")


@query(
    "q9_hashing_tf",
    f"""SELECT doc_id, slot, SUM(tf)::BIGINT AS tf FROM
        (SELECT doc_id, tf, (('0x' || substring(md5(term), 1, 8))::BIGINT % 1000)::INTEGER AS slot FROM {_TF}) GROUP BY 1, 2""",
)
def q9(t):
    def digest(c):
        return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")

    return ft.hashed_terms(_tf(t), "doc_id", 1000, digest)


@query("q10_idf", f"SELECT term, df, round(idf, 9) AS idf FROM {_IDF}")
def q10(t):
    return _rounded(ft.inverse_frequency(_tf(t), "doc_id"), 9, "idf")


@query("q11_tf_idf", f"SELECT doc_id, COUNT(*) AS terms, round(SUM(tf * idf), 5) AS weight FROM {_TF} JOIN {_IDF} USING (term) GROUP BY 1")
def q11(t):
    weights = ft.tf_idf(_tf(t), "doc_id")
    return weights.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("weight"))


@query("q12_word2vec")
def q12(t):
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    docs = t.conversations.select(F.split("text", r"[ \n\t]+").alias("words"))
    parts = t.spark.sparkContext.defaultParallelism
    fitted = Word2Vec(vectorSize=8, minCount=5, maxIter=1, seed=1, numPartitions=parts, inputCol="words", outputCol="v").fit(docs)
    return fitted.getVectors().select("word", vector_to_array("vector").alias("vector"))


_COS = """list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) /
    (sqrt(list_sum(list_transform(range(1, 65), lambda i: a[i] * a[i]))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: b[i] * b[i]))))"""


@query(
    "q13_synonyms_by_cosine",
    f"""SELECT vec_id, round({_COS}, 7) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS a,
        (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS b FROM embeddings WHERE vec_id <> 0) x ORDER BY score DESC, vec_id LIMIT 10""",
)
def q13(t):
    rows = _vectors(t)
    wanted = rows.filter("vec_id = 0").first()["features"]
    score = F.round(ft.cosine(F.col("features"), ft.literal_vector(wanted)), 7)
    return rows.filter("vec_id <> 0").select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(
    "q14_standard_scaler",
    """SELECT p_partkey, round((p_size - m1) / s1, 6) AS a, round((p_retailprice - m2) / s2, 6) AS b FROM part CROSS JOIN
       (SELECT AVG(p_size) AS m1, stddev_samp(p_size) AS s1, AVG(p_retailprice) AS m2, stddev_samp(p_retailprice) AS s2 FROM part)""",
)
def q14(t):
    rows = t.part.select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("v"))
    scaled = ft.standard_scale(rows, "v")
    return scaled.select("p_partkey", F.round(F.col("scaled")[0], 6).alias("a"), F.round(F.col("scaled")[1], 6).alias("b"))


@query(
    "q15_normalizer",
    """SELECT p_partkey, round(a / sqrt(a * a + b * b), 9) AS l2, round(a / (a + b), 9) AS l1, round(a / greatest(a, b), 9) AS linf
       FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part)""",
)
def q15(t):
    v = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"))
    kinds = {"l2": 2.0, "l1": 1.0, "linf": float("inf")}
    return t.part.select("p_partkey", *[F.round(ft.normalized(v, p)[0], 9).alias(k) for k, p in kinds.items()])


@query("q16_append_bias", "SELECT vec_id, 65 AS width, 1.0::DOUBLE AS last FROM embeddings")
def q16(t):
    v = ft.with_bias(F.col("features"))
    return _vectors(t).select("vec_id", F.size(v).alias("width"), F.element_at(v, -1).alias("last"))


# --- matrices ---------------------------------------------------------------------------------------

_CELLS = "(SELECT vec_id, (unnest(range(0, 64)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query("q17_gramian", f"SELECT a.i, b.i AS j, round(SUM(a.x * b.x), 6) AS v FROM {_CELLS} a JOIN {_CELLS} b USING (vec_id) GROUP BY 1, 2")
def q17(t):
    return _rounded(linalg.gramian(_vectors(t), "features"), 6, "v")


@query("q18_covariance", f"SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 8) AS v FROM {_CELLS} a JOIN {_CELLS} b USING (vec_id) GROUP BY 1, 2")
def q18(t):
    return _rounded(linalg.covariance(_vectors(t), "features"), 8, "v")


@query("q19_pca")
def q19(t):
    rows = _vectors(t)
    return linalg.multiply(rows, "features", linalg.principal_components(rows, "features", 3), "pc").select("vec_id", "pc")


@query("q20_svd")
def q20(t):
    """Rows of U by vec_id, of the singular values (part s, one row) and of V by column."""
    rows, s, v = linalg.svd(_vectors(t), "features", 4)
    rest = [("s", 0, s.tolist())] + [("v", i, row.tolist()) for i, row in enumerate(v)]
    left = rows.select(F.lit("u").alias("part"), F.col("vec_id").cast("long").alias("i"), F.col("u").cast("array<double>").alias("cells"))
    return left.unionAll(t.spark.createDataFrame(rest, "part string, i long, cells array<double>"))


@query(
    "q21_multiply_by_local_matrix",
    """SELECT vec_id, round(list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * ((i * 7) % 5 - 2))), 7) AS a,
              round(list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * ((i * 7 + 3) % 5 - 2))), 7) AS b FROM embeddings""",
)
def q21(t):
    matrix = np.array([[(i * 7 + 3 * j) % 5 - 2 for j in range(2)] for i in range(WIDTH)])
    rows = linalg.multiply(_vectors(t), "features", matrix)
    return rows.select("vec_id", F.round(F.col("product")[0], 7).alias("a"), F.round(F.col("product")[1], 7).alias("b"))


@query("q22_indexed_row_matrix", "SELECT vec_id AS i, 64 AS columns, round(embedding[4]::DOUBLE, 9) AS x3 FROM embeddings")
def q22(t):
    return _vectors(t).select(F.col("vec_id").alias("i"), F.size("features").alias("columns"), F.round(F.col("features")[3], 9).alias("x3"))


@query(
    "q23_coordinate_matrix_to_rows",
    """SELECT i, 0 AS chunk, string_agg(j || ':' || v, ',' ORDER BY j) AS cells FROM (SELECT c_nationkey AS i, length(c_mktsegment)::INTEGER AS j, COUNT(*) AS v
       FROM customer GROUP BY 1, 2) GROUP BY 1""",
)
def q23(t):
    entries = t.customer.groupBy(F.col("c_nationkey").alias("i"), F.length("c_mktsegment").alias("j")).agg(F.count("*").alias("v"))
    cells = F.transform("cells", lambda c: F.concat_ws(":", c["j"].cast("string"), c["v"].cast("string")))
    return linalg.entries_to_rows(entries).select("i", "chunk", F.array_join(cells, ",").alias("cells"))


# --- linear models -----------------------------------------------------------------------------------


def _keyed_regression(t):
    """Scaled part columns against the price: key, label, features with bias."""
    size, price = F.col("p_size") / 50 - 0.5, F.col("p_retailprice") / 1000
    features = F.array(size, F.pmod("p_partkey", F.lit(10)) / 10 - 0.45, F.lit(1.0))
    return t.part.select("p_partkey", price.alias("label"), features.alias("features"))


def _regression(t):
    return _keyed_regression(t).select("label", "features")


def _binary(t):
    """Embeddings with a 0/1 label."""
    return t.embeddings.select((F.col("label") < 5).cast("double").alias("label"), VEC("embedding").alias("features"))


def _weights(t, weights, losses=()):
    rows = [("weight", i, float(w)) for i, w in enumerate(weights)] + [("loss", i, float(x)) for i, x in enumerate(losses)]
    return t.spark.createDataFrame(rows, "kind string, i int, value double")


@query("q24_linear_regression_sgd")
def q24(t):
    return _weights(t, *linear.train_linear(_regression(t), rounds=8, step=0.5))


@query("q25_lasso_sgd")
def q25(t):
    return _weights(t, *linear.train_lasso(_regression(t), rounds=5, step=0.5, reg=0.01))


@query("q26_ridge_sgd")
def q26(t):
    return _weights(t, *linear.train_ridge(_regression(t), rounds=5, step=0.5, reg=0.01))


@query("q27_logistic_regression_sgd")
def q27(t):
    return _weights(t, *linear.train_logistic(_binary(t), rounds=5, step=1.0, reg=0.001))


@query("q28_logistic_regression_lbfgs")
def q28(t):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = _binary(t).select("label", array_to_vector("features").alias("features"))
    model = LogisticRegression(maxIter=10, regParam=0.01).fit(rows)
    rows = _weights(t, model.coefficients.toArray(), model.summary.objectiveHistory)
    return rows.unionAll(t.spark.createDataFrame([("intercept", 0, float(model.intercept))], rows.schema))


@query("q29_linear_svm_sgd")
def q29(t):
    return _weights(t, *linear.train_svm(_binary(t), rounds=5, step=1.0, reg=0.01))


@query("q30_minibatch_gradient_descent")
def q30(t):
    w, losses = linear.minibatch_sgd(_regression(t), linear.least_squares, linear.plain, np.zeros(3), 0.5, 6, fraction=0.5, seed=3)
    return _weights(t, w, losses)


@query("q31_lbfgs_distributed_cost")
def q31(t):
    return _weights(t, *linear.lbfgs(_regression(t), linear.least_squares, np.zeros(3), rounds=6))


_K = "CAST(json_extract(props, '$.k') AS INTEGER)"
_NB = f"""WITH r AS (SELECT user_id, event_type AS label, {_K} % 10 AS feature, COUNT(*) AS weight FROM events GROUP BY 1, 2, 3),
    d AS (SELECT label, COUNT(DISTINCT user_id) AS n FROM r GROUP BY 1),
    p AS (SELECT label, ln((n + 1.0) / ((SELECT SUM(n) FROM d) + (SELECT COUNT(*) FROM d))) AS prior FROM d),
    s AS (SELECT label, feature, SUM(weight) AS w FROM r GROUP BY 1, 2),
    th AS (SELECT label, feature, ln((w + 1.0) / (SUM(w) OVER (PARTITION BY label) + 10.0)) AS theta FROM s)"""


def _nb_rows(t):
    k = F.get_json_object("props", "$.k").cast("int") % 10
    rows = t.events.groupBy("user_id", F.col("event_type").alias("label"), k.alias("feature")).agg(F.count("*").alias("weight"))
    return rows.withColumn("key", F.concat_ws("/", "user_id", "label"))


@query("q32_naive_bayes", f"{_NB} SELECT th.label, feature, round(theta, 9) AS theta, round(prior, 9) AS prior FROM th JOIN p ON th.label = p.label")
def q32(t):
    priors, thetas = models.naive_bayes(_nb_rows(t), "key")
    return _rounded(thetas.join(priors, "label"), 9, "theta", "prior")


@query(
    "q66_naive_bayes_scoring",
    f"""{_NB}, sc AS (SELECT r.user_id, r.label AS own, p.label, round(SUM(weight * theta) + ANY_VALUE(prior), 9) AS s
        FROM r JOIN th USING (feature) JOIN p ON p.label = th.label GROUP BY 1, 2, 3)
        SELECT user_id || '/' || own AS key, arg_max(label, (s, -ord)) AS prediction FROM (SELECT *, dense_rank() OVER (ORDER BY label) AS ord FROM sc) GROUP BY 1""",
)
def q66(t):
    rows = _nb_rows(t)
    priors, thetas = models.naive_bayes(rows, "key")
    return models.naive_bayes_scores(rows.select("key", "feature", "weight"), "key", priors, thetas)


_SCORE = "list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * (((i * 7) % 5 - 2) / 10.0::DOUBLE)))"


def _score():
    return ft.dot(F.col("features"), ft.literal_vector([((i * 7) % 5 - 2) / 10 for i in range(WIDTH)]))


@query("q33_linear_scores", f"SELECT vec_id, round({_SCORE}, 7) AS score, ({_SCORE} > 0.05) AS positive FROM embeddings")
def q33(t):
    return _vectors(t).select("vec_id", F.round(_score(), 7).alias("score"), (_score() > 0.05).alias("positive"))


@query("q67_thresholded_classes", f"SELECT vec_id, round(1 / (1 + exp(-{_SCORE})), 7) AS probability, ({_SCORE} > 0)::INTEGER AS class FROM embeddings")
def q67(t):
    probability = F.round(1 / (1 + F.exp(-_score())), 7)
    return _vectors(t).select("vec_id", probability.alias("probability"), F.when(_score() > 0, 1).otherwise(0).alias("class"))


# --- clusters ---------------------------------------------------------------------------------------------


def _small(t):
    """Two-dimensional points: size and price of parts, scaled."""
    return t.part.select("p_partkey", F.array(F.col("p_size") / 50, F.col("p_retailprice") / 1000).alias("features"))


_CENTERS = np.array([[0.2, 0.92], [0.5, 0.95], [0.8, 0.97]])


@query("q34_kmeans")
def q34(t):
    centers, cost = models.kmeans(_small(t), "features", 3, rounds=4, runs=2, seed=4)
    return t.spark.createDataFrame([(i, *[float(x) for x in c], float(cost)) for i, c in enumerate(centers)], "cluster int, x double, y double, cost double")


@query("q34_kmeans_pipeline")
def q34_pipeline(t):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = _vectors(t).select("vec_id", array_to_vector("features").alias("features"))
    return KMeans(k=5, seed=1, maxIter=5).fit(rows).transform(rows).groupBy("prediction").agg(_n())


_D = [f"(power(x - {c[0]}, 2) + power(y - {c[1]}, 2))" for c in _CENTERS]
_POINTS = "(SELECT p_partkey, p_size / 50 AS x, p_retailprice / 1000 AS y FROM part)"


@query("q35_kmeans_cost", f"SELECT round(SUM(least({', '.join(_D)})), 7) AS cost FROM {_POINTS}")
def q35(t):
    return models.assign_clusters(_small(t), "features", _CENTERS).agg(F.round(F.sum("cost"), 7).alias("cost"))


@query(
    "q69_kmeans_assignment",
    f"""SELECT cluster, COUNT(*) AS n FROM (SELECT CASE WHEN {_D[0]} <= {_D[1]} AND {_D[0]} <= {_D[2]} THEN 0 WHEN {_D[1]} <= {_D[2]} THEN 1 ELSE 2 END
        AS cluster FROM {_POINTS}) GROUP BY 1""",
)
def q69(t):
    return models.assign_clusters(_small(t), "features", _CENTERS).groupBy("cluster").agg(_n())


@query("q68_kmeans_parallel_start")
def q68(t):
    centers = models.kmeans_parallel_start(_vectors(t), "features", 5, rounds=2, seed=6)
    return t.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "i int, center array<double>")


# --- trees ------------------------------------------------------------------------------------------------


def _tree_rows(t):
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = StringIndexer(inputCol="p_type", outputCol="type").fit(t.part).transform(t.part)
    return VectorAssembler(inputCols=["p_size", "p_retailprice", "type"], outputCol="features").transform(rows)


@query("q36_decision_tree_classifier")
def q36(t):
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = _tree_rows(t).withColumn("label", F.when((F.col("p_size") > 20) & (F.col("type") < 3), 1.0).otherwise(0.0))
    return union_all_of(
        [
            DecisionTreeClassifier(maxDepth=4, impurity=i).fit(rows).transform(rows).groupBy(F.lit(i).alias("impurity"), "label", "prediction").agg(_n())
            for i in ("gini", "entropy")
        ]
    )


@query("q36_decision_tree_regressor")
def q36_regressor(t):
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = _tree_rows(t).withColumn("label", F.col("p_size") * 2.0)
    return DecisionTreeRegressor(maxDepth=4).fit(rows).transform(rows).groupBy("prediction").agg(_n())


_TREE = {
    "feature": "p_size", "threshold": 25,
    "left": {"feature": "p_type", "categories": ["PROMO", "LARGE"], "left": {"value": 1.0}, "right": {"value": 2.0}},
    "right": {"feature": "p_retailprice", "threshold": 950.0, "left": {"value": 3.0}, "right": {"value": 4.0}},
}


@query(
    "q37_tree_prediction",
    """SELECT p_partkey, (CASE WHEN p_size <= 25 THEN CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 1.0 ELSE 2.0 END
       ELSE CASE WHEN p_retailprice <= 950 THEN 3.0 ELSE 4.0 END END)::DOUBLE AS prediction FROM part""",
)
def q37(t):
    return t.part.select("p_partkey", models.tree_prediction(_TREE).alias("prediction"))


@query("q70_split_candidates")
def q70(t):
    return models.split_candidates(t.lineitem, ["l_quantity", "l_extendedprice"], 8, 0.2, 1)


@query(
    "q71_impurity",
    """SELECT p_brand, round(1 - SUM(c * c) / power(SUM(c), 2), 9) AS gini, round(-SUM(c / n * log2(c / n)), 9) AS entropy,
       round(SUM(c * p_size * p_size) / SUM(c) - power(SUM(c * p_size) / SUM(c), 2), 6) AS variance FROM
       (SELECT *, SUM(c) OVER (PARTITION BY p_brand) AS n FROM (SELECT p_brand, p_size, COUNT(*)::DOUBLE AS c FROM part GROUP BY 1, 2)) GROUP BY 1""",
)
def q71(t):
    return _rounded(_rounded(models.impurities(t.part, ["p_brand"], "p_size"), 9, "gini", "entropy"), 6, "variance")


# --- factors ------------------------------------------------------------------------------------------------


def _ratings(t):
    lines = t.lineitem.join(t.orders, F.expr("l_orderkey = o_orderkey"))
    return lines.groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")).agg(F.avg("l_quantity").alias("rating"))


def _als(t, **options):
    from pyspark.ml.recommendation import ALS

    als = ALS(rank=4, maxIter=2, regParam=0.1, seed=1, userCol="user", itemCol="item", ratingCol="rating", **options)
    model = als.fit(_ratings(t))
    sides = {"user": model.userFactors, "item": model.itemFactors}
    return union_all_of([f.select(F.lit(side).alias("side"), "id", "features") for side, f in sides.items()])


query("q38_als_explicit")(lambda t: _als(t))
query("q39_als_implicit")(lambda t: _als(t, implicitPrefs=True, alpha=0.5))
query("q40_als_nonnegative")(lambda t: _als(t, nonnegative=True))


def _factors(t):
    users = t.customer.select(F.col("c_custkey").alias("user"), F.array(F.col("c_acctbal") / 1000, F.lit(1.0)).alias("uf"))
    items = t.part.select(F.col("p_partkey").alias("item"), F.array(F.col("p_size") / 10, F.col("p_retailprice") / 100).alias("pf"))
    return users, items


_DOT = "round(c_acctbal / 1000 * (p_size / 10) + p_retailprice / 100, 6)"


@query("q41_predict_ratings", f"SELECT c_custkey AS user, p_partkey AS item, {_DOT} AS rating FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey")
def q41(t):
    users, items = _factors(t)
    pairs = _ratings(t).select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"))
    return _rounded(models.predict_ratings(pairs, users, items), 6, "rating")


@query("q42_recommend_products", f"SELECT p_partkey AS item, {_DOT} AS score FROM part, customer WHERE c_custkey = 5 ORDER BY score DESC, item LIMIT 10")
def q42(t):
    users, items = _factors(t)
    wanted = users.filter("user = 5").first()["uf"]
    return _rounded(models.top_matches(items, "item", "pf", wanted, 10), 6, "score")


@query("q72_recommend_users", f"SELECT c_custkey AS user, {_DOT} AS score FROM part, customer WHERE p_partkey = 9 ORDER BY score DESC, user LIMIT 10")
def q72(t):
    users, items = _factors(t)
    wanted = items.filter("item = 9").first()["pf"]
    return _rounded(models.top_matches(users, "user", "uf", wanted, 10), 6, "score")


@query(
    "q73_block_traffic",
    """SELECT user_block, item_block, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS users FROM (SELECT o_custkey % 4 AS user_block, l_partkey % 4 AS item_block, o_custkey
       FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) GROUP BY 1, 2""",
)
def q73(t):
    blocks = _ratings(t).select((F.col("user").cast("long") % 4).alias("user_block"), (F.col("item").cast("long") % 4).alias("item_block"), "user")
    return blocks.groupBy("user_block", "item_block").agg(_n(), F.count_distinct("user").alias("users"))


# --- metrics ----------------------------------------------------------------------------------------------------

_CELLS2 = "(SELECT quality AS label, toxic AS prediction, COUNT(*) AS n FROM labels GROUP BY 1, 2)"


@query("q43_confusion_matrix", f"SELECT * FROM {_CELLS2}")
def q43(t):
    return metrics.confusion(t.labels, "toxic", "quality")


_BY_CLASS = f"""(SELECT label, coalesce(hit / said, 0) AS precision, hit / actual AS recall, actual / total AS share,
    coalesce((said - hit) / (total - actual), 0) AS false_positive_rate FROM
    (SELECT label, SUM(n) AS actual, SUM(CASE WHEN label = prediction THEN n ELSE 0 END) AS hit FROM {_CELLS2} GROUP BY 1) a
    LEFT JOIN (SELECT prediction AS label, SUM(n) AS said FROM {_CELLS2} GROUP BY 1) b USING (label) CROSS JOIN (SELECT SUM(n) AS total FROM {_CELLS2}) c)"""


_F_BETA = "CASE WHEN precision + recall > 0 THEN 1.25::DOUBLE * precision * recall / (0.25::DOUBLE * precision + recall) ELSE 0 END"


@query(
    "q43_class_metrics",
    f"""SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(share, 9) AS share,
        round(false_positive_rate, 9) AS false_positive_rate, round({_F_BETA}, 9) AS f FROM {_BY_CLASS}""",
)
def q43_class(t):
    by_class = metrics.class_metrics(metrics.confusion(t.labels, "toxic", "quality"), beta=0.5)
    return _rounded(by_class, 9, "precision", "recall", "false_positive_rate", "f", "share")


@query(
    "q43_weighted_metrics",
    f"""SELECT round(SUM(precision * share), 9) AS precision, round(SUM(recall * share), 9) AS recall,
        round(SUM(false_positive_rate * share), 9) AS false_positive_rate, round(SUM({_F_BETA} * share), 9) AS f FROM {_BY_CLASS}""",
)
def q43_weighted(t):
    by_class = metrics.class_metrics(metrics.confusion(t.labels, "toxic", "quality"), beta=0.5)
    return _rounded(metrics.weighted_metrics(by_class), 9, "precision", "recall", "false_positive_rate", "f")


def _scored(t):
    rows = t.documents.join(t.labels, "doc_id")
    return rows.select(F.floor(F.col("n_chars") / 100).alias("score"), "quality")


_THR = """WITH c AS (SELECT (n_chars // 100)::BIGINT AS threshold, SUM((quality = 1)::INTEGER) AS p, SUM((quality <> 1)::INTEGER) AS q
    FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    k AS (SELECT threshold, SUM(p) OVER w AS tp, SUM(q) OVER w AS fp, SUM(p) OVER () AS positives, SUM(q) OVER () AS negatives FROM c WINDOW w AS (ORDER BY threshold DESC)),"""
_ROC = f"{_THR} r AS (SELECT threshold, fp / negatives AS x, tp / positives AS y FROM k)"
_PR = f"{_THR} r AS (SELECT threshold, tp / positives AS x, tp / (tp + fp) AS y FROM k)"


def _area_sql(curve, first, last=None):
    ends = f"UNION ALL SELECT 1e18, {first}" + (f" UNION ALL SELECT -1e18, {last}" if last else "")
    return f"""{curve} SELECT round(SUM((x1 - x) * (y + y1) / 2), 9) AS area FROM (SELECT x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1
        FROM (SELECT threshold::DOUBLE AS threshold, x, y FROM r {ends}) WINDOW w AS (ORDER BY threshold DESC))"""


@query("q44_roc_points", f"{_ROC} SELECT threshold, round(x, 9) AS x, round(y, 9) AS y FROM r")
def q44(t):
    return _rounded(metrics.roc_points(metrics.threshold_counts(_scored(t), "score", "quality")), 9, "x", "y")


@query("q44_area_under_roc", _area_sql(_ROC, "0, 0", "1, 1"))
def q44_area(t):
    points = metrics.roc_points(metrics.threshold_counts(_scored(t), "score", "quality"))
    return _rounded(metrics.area_under(points, (0.0, 0.0), (1.0, 1.0)), 9, "area")


@query("q45_pr_points", f"{_PR} SELECT threshold, round(x, 9) AS x, round(y, 9) AS y FROM r")
def q45(t):
    return _rounded(metrics.pr_points(metrics.threshold_counts(_scored(t), "score", "quality")), 9, "x", "y")


@query("q45_area_under_pr", _area_sql(_PR, "0, 1"))
def q45_area(t):
    points = metrics.pr_points(metrics.threshold_counts(_scored(t), "score", "quality"))
    return _rounded(metrics.area_under(points, (0.0, 1.0)), 9, "area")


@query(
    "q46_measures_by_threshold",
    f"""{_PR} SELECT threshold, round(y, 9) AS precision, round(x, 9) AS recall,
        round(CASE WHEN x + y > 0 THEN 5 * x * y / (4 * y + x) ELSE 0 END, 9) AS f FROM r""",
)
def q46(t):
    return _rounded(metrics.by_threshold(metrics.threshold_counts(_scored(t), "score", "quality"), 2.0), 9, "precision", "recall", "f")


@query("q79_thresholds", "SELECT DISTINCT (n_chars // 100)::BIGINT AS threshold FROM documents JOIN labels USING (doc_id) ORDER BY 1 DESC")
def q79(t):
    return _scored(t).select(F.col("score").alias("threshold")).distinct().orderBy(F.desc("threshold"))


# --- generators --------------------------------------------------------------------------------------------------


def _ids(t):
    return t.orders.select(F.col("o_orderkey").alias("id"))


query("q47_linear_data")(lambda t: models.linear_data(_ids(t), [1.0, -2.0, 0.5], 3.0))
query("q75_kmeans_data")(lambda t: models.kmeans_data(_ids(t), 4, 3))
query("q76_logistic_data")(lambda t: models.logistic_data(_ids(t)))
query("q77_svm_data")(lambda t: models.svm_data(_ids(t), [1.0, -1.0]))


@query("q78_factor_data")
def q78(t):
    cells = t.orders.select((F.col("o_orderkey") % 500).alias("user"), F.col("o_custkey").alias("item")).distinct()
    return models.factor_data(cells)


@query("q48_binary_label_check", "SELECT 'quality' AS label, COUNT(*) = 0 AS binary FROM labels WHERE quality NOT IN (0, 1) UNION ALL SELECT 'class', COUNT(*) = 0 FROM embeddings WHERE label NOT IN (0, 1)")
def q48(t):
    a = linear.labels_are_binary(t.labels.select(F.col("quality").alias("label")))
    b = linear.labels_are_binary(t.embeddings.select("label"))
    return t.spark.createDataFrame([("quality", a), ("class", b)], "label string, binary boolean")


# --- perceptron -----------------------------------------------------------------------------------------------------


def _digits(t):
    """Embeddings with a one-hot target over the ten labels."""
    target = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("double"))
    return t.embeddings.select("vec_id", VEC("embedding").alias("features"), target.alias("target"))


_TOPOLOGY = [WIDTH, 16, 10]


@query("q49_perceptron_training")
def q49(t):
    """All weights as (layer, row, col, value), column 0 the bias; layer -1 has the loss of each round."""
    flat, losses = neural.train(_digits(t), _TOPOLOGY, rounds=5, batch=25, reg=1e-4, seed=2)
    cells = [(layer, r, c + 1, float(v)) for layer, (matrix, _) in enumerate(neural.split_weights(flat, _TOPOLOGY)) for (r, c), v in np.ndenumerate(matrix)]
    cells += [(layer, r, 0, float(v)) for layer, (_, bias) in enumerate(neural.split_weights(flat, _TOPOLOGY)) for r, v in enumerate(bias)]
    cells += [(-1, i, 0, float(v)) for i, v in enumerate(losses)]
    return t.spark.createDataFrame(cells, "layer int, row int, col int, value double")


@query("q50_batch_stacking")
def q50(t):
    return neural.stack_rows(_digits(t), 32).select("n", F.size("features").alias("numbers"), F.size("targets").alias("targets"))


@query(
    "q51_adadelta_update",
    """SELECT p_partkey, round(g * sqrt(1e-8::DOUBLE + d) / sqrt(1e-8::DOUBLE + s), 9) AS step FROM (SELECT p_partkey, p_size / 10 AS g,
       0.99::DOUBLE * (p_retailprice / 1000) + 0.01::DOUBLE * power(p_size / 10, 2) AS s, p_retailprice / 5000 AS d FROM part)""",
)
def q51(t):
    """One update per weight, as a table expression over (gradient, running gradient, running step)."""
    g = F.col("p_size") / 10
    running = 0.99 * (F.col("p_retailprice") / 1000) + 0.01 * F.pow(g, F.lit(2.0))
    step = g * F.sqrt(1e-8 + F.col("p_retailprice") / 5000) / F.sqrt(1e-8 + running)
    return t.part.select("p_partkey", F.round(step, 9).alias("step"))


@query("q52_perceptron_error_untrained")
def q52_untrained(t):
    return neural.error_rate(_digits(t), neural.initial_weights(_TOPOLOGY, 3), _TOPOLOGY)


@query(
    "q52_perceptron_error",
    """SELECT round(AVG((list_position(s, list_max(s)) - 1 <> label)::INTEGER), 9) AS error FROM (SELECT label, list_transform(range(0, 10),
       lambda j: list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * ((i * 7 + j * 3) % 11 - 5)))) AS s FROM embeddings)""",
)
def q52(t):
    """A network of one softmax layer with fixed weights."""
    j, i = np.indices((10, WIDTH))
    flat = neural.join_weights([((i * 7.0 + j * 3) % 11 - 5, np.zeros(10))])
    return _rounded(neural.error_rate(_digits(t), flat, [WIDTH, 10]), 9, "error")


@query("q53_parameter_table_training")
def q53(t):
    table = neural.train_through_table(_digits(t), _TOPOLOGY, rounds=2, rate=0.5, batch=50)
    return table.select("layer", "row", "col", "value")


@query(
    "q54_parameter_merge",
    """SELECT layer, "row", col, round(v + 0.1::DOUBLE * coalesce(g, 0), 6) AS value FROM
       (SELECT p_size % 2 AS layer, p_size % 10 AS "row", (p_partkey % 7)::INTEGER AS col, MAX(p_retailprice) AS v FROM part GROUP BY 1, 2, 3)
       LEFT JOIN (SELECT l_linenumber % 2 AS layer, (l_quantity % 10)::INTEGER AS "row", (l_suppkey % 9)::INTEGER AS col, AVG(l_discount) AS g
       FROM lineitem GROUP BY 1, 2, 3) USING (layer, "row", col)""",
)
def q54(t):
    keys = (F.col("p_size") % 2).alias("layer"), (F.col("p_size") % 10).alias("row"), (F.col("p_partkey") % 7).cast("int").alias("col")
    params = t.part.groupBy(*keys).agg(F.max("p_retailprice").alias("value"))
    grads = t.lineitem.select(
        (F.col("l_linenumber") % 2).alias("layer"), (F.col("l_quantity") % 10).cast("int").alias("row"),
        (F.col("l_suppkey") % 9).cast("int").alias("col"), F.col("l_discount").alias("gradient"),
    )
    return _rounded(neural.merge_gradients(params, grads, 0.1), 6, "value")


@query("q55_parameter_initialisation")
def q55(t):
    """Cells of a network whose input layer has one unit per nation of the customer table."""
    nations = t.customer.agg(F.count_distinct("c_nationkey").alias("n")).first()["n"]
    return neural.parameter_table(t.spark, [nations, 8, 4], seed=5)


# --- jobs ------------------------------------------------------------------------------------------------------------


@query("q56_log_statistics", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, COUNT(*) AS n, SUM(length(html))::BIGINT AS bytes FROM pages GROUP BY 1")
def q56(t):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return t.pages.groupBy(host.alias("host")).agg(_n(), F.sum(F.length("html")).alias("bytes"))


@query("q57_skewed_group_by", "SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS k, COUNT(*) AS n, SUM(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1")
def q57(t):
    """A third of the rows share one key; each task sends one row of partial results for it."""
    rows = t.lineitem.withColumn("k", F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_orderkey")))
    return rows.groupBy("k").agg(_n(), F.sum("l_linenumber").alias("lines"))


@query("q58_mergeable_summary", " UNION ALL ".join(_summary_sql(c) for c in ("l_quantity", "l_tax")))
def q58(t):
    cols = ["l_quantity", "l_tax"]
    flags = ["R", "A", "N"]
    parts = [stats.column_summary(t.lineitem.filter(F.col("l_returnflag") == f), cols) for f in flags]
    rest = stats.column_summary(t.lineitem.filter(~F.col("l_returnflag").isin(flags)), cols).filter("n > 0")
    merged = stats.merge_summaries(union_all_of([*parts, rest]))
    return _rounded(_rounded(merged, 6, "mean"), 4, "variance")


@query("q59_spearman", f"SELECT round(corr(p_size, p_retailprice), 9) AS r FROM {_RANKED}")
def q59(t):
    rows = stats.correlation_matrix(t.part, ["p_size", "p_retailprice"], "spearman")
    return rows.filter("a = 'p_size' AND b = 'p_retailprice'").select(F.round("corr", 9).alias("r"))


_XY = "(SELECT p_size / 50 AS x, p_retailprice / 1000 AS z, (p_partkey % 2)::DOUBLE AS y FROM part)"


def _xy(t):
    return t.part.select(
        F.array(F.col("p_size") / 50, F.col("p_retailprice") / 1000).alias("features"), (F.col("p_partkey") % 2).cast("double").alias("label")
    )


def _gradient_query(row, slug, fn, factor, loss):
    sql = f"SELECT round(SUM({factor} * x), 6) AS g0, round(SUM({factor} * z), 6) AS g1, round(SUM({loss}), 6) AS loss FROM (SELECT *, 0.3::DOUBLE * x - 0.2::DOUBLE * z AS m, 2 * y - 1 AS s FROM {_XY})"

    @query(f"{row}_{slug}", sql)
    def run(t):
        g, total, _ = linear.summed_gradient(_xy(t), fn, np.array([0.3, -0.2]))
        return t.spark.createDataFrame([tuple(round(float(v), 6) for v in (*g, total))], "g0 double, g1 double, loss double")


_gradient_query("q60", "gradient_logistic", linear.logistic, "(1 / (1 + exp(-m)) - y)", "ln(1 + exp(-m)) + (1 - y) * m")
_gradient_query("q61", "gradient_least_squares", linear.least_squares, "2 * (m - y)", "power(m - y, 2)")
_gradient_query("q62", "gradient_hinge", linear.hinge, "(CASE WHEN 1 - s * m > 0 THEN -s ELSE 0 END)", "greatest(1 - s * m, 0)")


def _updater_query(row, slug, fn, new):
    """Weights and gradients as a table; the update of one round is a driver step on that small table."""
    sql = f"SELECT c_nationkey AS i, round({new}, 6) AS w FROM (SELECT c_nationkey, AVG(c_acctbal) / 1000 AS w, MAX(c_acctbal) / 10000 - 0.5::DOUBLE AS g FROM customer GROUP BY 1)"

    @query(f"{row}_{slug}", sql)
    def run(t):
        cells = t.customer.groupBy("c_nationkey").agg((F.avg("c_acctbal") / 1000).alias("w"), (F.max("c_acctbal") / 10000 - 0.5).alias("g"))
        table = cells.orderBy("c_nationkey").toPandas()
        w, _ = fn(table.w.to_numpy(), table.g.to_numpy(), 0.8, 4, 0.05)
        rows = [(int(i), round(float(v), 6)) for i, v in zip(table.c_nationkey, w)]
        return t.spark.createDataFrame(rows, "i int, w double")


_updater_query("q63", "updater_plain", linear.plain, "w - 0.4::DOUBLE * g")
_updater_query("q64", "updater_l1", linear.soft_threshold_l1, "sign(w - 0.4::DOUBLE * g) * greatest(abs(w - 0.4::DOUBLE * g) - 0.02::DOUBLE, 0)")
_updater_query("q65", "updater_squared_l2", linear.squared_l2, "w * 0.98::DOUBLE - 0.4::DOUBLE * g")


@query("q74_vocabulary", f"SELECT term, SUM(tf)::BIGINT AS n FROM {_TF} GROUP BY 1 HAVING SUM(tf) >= 5")
def q74(t):
    return ft.vocabulary(_tf(t), 5)


@query("q80_monte_carlo_pi")
def q80(t):
    """One point per line of the orders."""
    points = t.lineitem.select((F.rand(1) * 2 - 1).alias("x"), (F.rand(2) * 2 - 1).alias("y"))
    return points.agg((4 * F.avg((F.col("x") ** 2 + F.col("y") ** 2 <= 1).cast("double"))).alias("pi"))


@query("q81_word_count", r"SELECT word, COUNT(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \n\t]+')) AS word FROM documents) x GROUP BY 1")
def q81(t):
    return t.documents.select(F.explode(F.split("text", r"[ \n\t]+")).alias("word")).groupBy("word").agg(_n())


@query("q82_global_sort", "SELECT l_extendedprice AS v, COUNT(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1")
def q82(t):
    return t.lineitem.groupBy(F.col("l_extendedprice").alias("v")).agg(_n()).orderBy("v")


def _als_sql(rounds):
    ctes = ["""r AS (SELECT o_custkey::INTEGER AS u, l_partkey::INTEGER AS i, AVG(l_quantity) / 50 AS x FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""", "i0 AS (SELECT DISTINCT i, 1.0::DOUBLE AS q FROM r)"]
    for k in range(1, rounds + 1):
        ctes.append(f"u{k} AS (SELECT u, SUM(x * q) / (SUM(q * q) + 0.1) AS p FROM r JOIN i{k - 1} USING (i) GROUP BY 1)")
        ctes.append(f"i{k} AS (SELECT i, SUM(x * p) / (SUM(p * p) + 0.1) AS q FROM r JOIN u{k} USING (u) GROUP BY 1)")
    return f"WITH {', '.join(ctes)} SELECT i AS item, round(q, 8) AS q FROM i{rounds}"


@query("q83_als_by_hand", _als_sql(2))
def q83(t):
    """Rank-one alternating least squares over blocks of users and items, two rounds."""
    _, items = als(_ratings(t).withColumn("rating", F.col("rating") / 50), 1, 2, 0.1, start=1.0)
    return items.select("item", F.round(F.col("factors")[0], 8).alias("q"))


@query("q84_kmeans_by_hand")
def q84(t):
    centers = _CENTERS
    for _ in range(2):
        centers = models.kmeans_step(_small(t), "features", centers)
    return models.assign_clusters(_small(t), "features", centers).groupBy("cluster").agg(_n())


@query("q85_logistic_by_hand")
def q85(t):
    rows, w = _xy(t), np.zeros(2)
    for _ in range(3):
        g, _, n = linear.summed_gradient(rows, linear.logistic, w)
        w = w - g / n
    return _weights(t, w)


# --- learning on streams -----------------------------------------------------------------------------------------------


def _online(t, step, rounds):
    """A model that trains on three batches of parts, by ``rounds`` gradient steps in each, and those batches."""
    from brindle.streaming.model import StreamedModel
    from brindle.streaming.sources import BatchQueue

    queue = BatchQueue(_keyed_regression(t), F.pmod("p_partkey", F.lit(3)), 3, "online")

    def train(batch, weights):
        return linear.minibatch_sgd(batch, linear.least_squares, linear.plain, weights, step, rounds)[0]

    return StreamedModel(t.spark, np.zeros(3), train), queue


@query("n43_online_linear_regression")
def n43(t):
    """Weights after each of three batches; the training stops after two and goes on from its checkpoint."""
    from brindle.streaming.model import StreamedModel

    model, queue = _online(t, 0.5, 3)
    model.train_on(queue.stream, feeds=queue.feeds[:2])
    again = StreamedModel(t.spark, model.start, model.train, model.checkpoint)
    again.train_on(queue.stream, feeds=queue.feeds[2:])
    return again.history().select("version", F.posexplode("weights").alias("i", "weight"))


@query("n50_predict_on_values")
def n50(t):
    """One stream trains, a second one scores parts by key with the newest weights, batch by batch in turn."""
    model, queue = _online(t, 0.5, 3)
    scored = _online(t, 0.5, 3)[1]

    def train_then_feed(i):
        model.train_on(queue.stream, feeds=[queue.feeds[i]])
        scored.feeds[i]()

    return model.predict_on(scored.stream, "p_partkey", "features", feeds=[lambda i=i: train_then_feed(i) for i in range(3)])


@query("n51_online_regression_defaults")
def n51(t):
    """Step 0.1 and 50 rounds a batch, as a model has them that is told nothing."""
    model, queue = _online(t, 0.1, 50)
    model.train_on(queue.stream, feeds=queue.feeds)
    return _weights(t, model.weights()[1])
