import zlib

import numpy as np
import pyarrow as pa
from helpers import MESSY, empty, messy

from brindle.llm import quality as Q
from brindle.llm.common import utf8_buffers
from brindle.session import Tables

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    t = Tables(spark, SF)
    scored = Q.score_quality(t.documents, t.labels)
    rows = scored.join(t.labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    poor = [r.score for r in rows if r.quality == 0]
    good = [r.score for r in rows if r.quality == 1]
    assert np.mean([p < g for p in poor for g in good]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored.collect())


def test_held_out_labels_do_not_teach(spark):
    from pyspark.sql import functions as F

    t = Tables(spark, SF)
    flipped = t.labels.withColumn("quality", F.when(Q.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in Q.score_quality(t.documents, x).collect()} for x in (t.labels, flipped))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_discriminant_is_the_normal_log_ratio():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(50, 3)), rng.normal(size=(80, 3)) * 2 + 1]
    model = Q.fit({k: (len(v), v.sum(0), v.T @ v) for k, v in enumerate(x)}, 0.2, 0.1)
    covariances = [np.cov(v.T, bias=True) for v in x]
    pooled = (50 * covariances[0] + 80 * covariances[1]) / 130
    point = np.array([[0.3, -1.0, 2.0]])
    density = []
    for v, c in zip(x, covariances, strict=True):
        s = Q.shrunk(c, pooled, 0.2, 0.1)
        d = point[0] - v.mean(0)
        density.append(np.log(len(v) / 130) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * d @ np.linalg.solve(s, d))
    assert abs(model.log_ratio(point)[0] - (density[1] - density[0])) < 1e-9


def test_moments_over_partitions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    rows = spark.createDataFrame([(v.tolist(), i % 2) for i, v in enumerate(x)], "x array<double>, label int").repartition(5)
    for k, (n, total, square) in Q.class_moments(rows, np.zeros(2)).items():
        assert n == 20 and np.allclose(total, x[k::2].sum(0)) and np.allclose(square, x[k::2].T @ x[k::2])


def test_statistics_of_odd_texts():
    texts = [None, "", " \n", "a", "\n" * 50, "🎉" * 9, "word " * 100_000]
    x = Q.statistics_of(*utf8_buffers(pa.array(texts, pa.string())))
    assert x.shape == (len(texts), len(Q.FEATURES)) and np.isfinite(x).all()


def test_nulls_one_class_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (5, None, 1), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.filter("quality = 1"), labels.limit(0)):
        rows = Q.score_quality(messy(spark), known).collect()
        assert len(rows) == len(MESSY) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out is False for r in rows if r.doc_id is None)
        if known is not labels:
            assert {(r.score, r.predicted) for r in rows} == {(0.5, 1)}
    kept = Q.good_documents(messy(spark), labels.limit(0))
    assert kept.columns == messy(spark).columns and kept.count() == len(MESSY)
    assert Q.score_quality(empty(spark), labels).collect() == []
