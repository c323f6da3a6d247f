"""Set operations, samples, partitioning."""

from pyspark.sql import functions as F

from brindle.operators.relational import attach_row, except_keep_duplicates, intersect_rows, union_all_of
from brindle.operators.sampling import (
    bucket_sample,
    exact_stratified_sample,
    k_folds,
    reservoir_per_partition,
    take_sample,
    take_sample_with_replacement,
    unit_hash,
    unit_range_sample,
)
from brindle.registry import query, sql_query

sql_query(
    "f1_union_all",
    "SELECT o_custkey AS k FROM {orders} UNION ALL SELECT c_custkey FROM {customer}",
)
sql_query("f2_union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")


@query("f3_union_widening", "SELECT CAST(c_custkey AS VARCHAR) AS v FROM customer UNION ALL SELECT p_brand FROM part")
def f3(t):
    """String wins over number; the cast is written out."""
    return t.customer.select(F.col("c_custkey").cast("string").alias("v")).unionAll(t.part.select("p_brand"))


sql_query("f4_intersect", "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT user_id FROM {events}")


def _left(t):
    return t.lineitem.select("l_suppkey", F.expr("nullif(l_linenumber % 3, 0)").alias("m"))


def _right(t):
    return t.supplier.select("s_suppkey", F.expr("nullif(s_nationkey % 3, 0)").alias("m"))


_EXCEPT = """SELECT l_suppkey, coalesce(m, -1) AS m FROM
    (SELECT l_suppkey, nullif(l_linenumber % 3, 0) AS m FROM lineitem) l WHERE NOT EXISTS
    (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND nullif(s_nationkey % 3, 0) IS NOT DISTINCT FROM l.m)"""


def _except(t):
    return except_keep_duplicates(_left(t), _right(t)).withColumn("m", F.coalesce("m", F.lit(-1)))


query("f5_except_keeps_duplicates", _EXCEPT)(_except)
sql_query("f5_except_distinct", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT user_id FROM {events}")


@query("f6_union", "SELECT s_suppkey AS k FROM supplier UNION ALL SELECT p_partkey FROM part")
def f6(t):
    return t.supplier.select(F.col("s_suppkey").alias("k")).unionAll(t.part.select("p_partkey"))


@query("f7_intersection", "SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT s_suppkey FROM supplier")
def f7(t):
    return intersect_rows(t.lineitem.select(F.col("l_suppkey").alias("k")), t.supplier.select("s_suppkey"))


@query("f8_subtract", "SELECT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def f8(t):
    return except_keep_duplicates(t.orders.select(F.col("o_custkey").alias("k")), t.events.select("user_id"))


@query("f9_sample")
def f9(t):
    without = t.orders.sample(False, 0.2, 11).agg(F.lit("without").alias("how"), F.count("*").alias("n"))
    return without.unionAll(t.orders.sample(True, 0.5, 11).agg(F.lit("with"), F.count("*")))


def _sampled(name, text):
    query(name)(lambda t: t.sql(text))


_sampled("f10_table_sample", "SELECT COUNT(*) AS n FROM {orders} TABLESAMPLE (20 PERCENT)")
_sampled("f11_table_sample_rows", "SELECT COUNT(*) AS n FROM {orders} TABLESAMPLE (50 ROWS)")
_sampled("f32_table_sample_percent", "SELECT COUNT(*) AS n FROM {lineitem} TABLESAMPLE (5 PERCENT)")


@query("f12_table_sample_bucket")
def f12(t):
    rows = t.sql("SELECT 'random' AS how, COUNT(*) AS n FROM {orders} TABLESAMPLE (BUCKET 2 OUT OF 8)")
    return rows.unionAll(bucket_sample(t.orders, 2, 8, "o_orderkey").agg(F.lit("by hash"), F.count("*")))


@query("f13_take_sample")
def f13(t):
    rows = t.customer.select("c_custkey")
    return take_sample(rows, 100, 5).unionAll(take_sample_with_replacement(rows, 50, 5))


@query("f14_random_split")
def f14(t):
    parts = t.orders.select("o_orderkey").randomSplit([0.6, 0.3, 0.1], 17)
    return union_all_of([p.agg(F.lit(i).alias("part"), F.count("*").alias("n")) for i, p in enumerate(parts)])


@query("f15_stratified_sample")
def f15(t):
    return t.events.sampleBy("event_type", {"error": 0.5, "click": 0.1}, 3).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "f16_exact_stratified_sample",
    """SELECT event_id, event_type FROM (SELECT event_id, event_type,
         row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r,
         COUNT(*) OVER (PARTITION BY event_type) AS n FROM events) x
       WHERE (event_type = 'error' AND r <= ceil(0.25::DOUBLE * n)) OR (event_type = 'click' AND r <= ceil(0.1::DOUBLE * n))""",
)
def f16(t):
    """Exact sizes per stratum; the order is a column here so that SQL can repeat it."""
    rows = t.events.select("event_id", "event_type", "value")
    kept = exact_stratified_sample(rows, "event_type", {"error": 0.25, "click": 0.1}, [F.col("value"), F.col("event_id")])
    return kept.select("event_id", "event_type")


@query("f16_exact_stratified_sample_random")
def f16_random(t):
    rows = t.events.select("event_id", "event_type")
    kept = exact_stratified_sample(rows, "event_type", {"error": 0.25, "view": 0.5}, [unit_hash(F.col("event_id"), seed=9)])
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("f17_k_fold")
def f17(t):
    folds = k_folds(t.orders.select("o_orderkey"), 4, 23)
    counts = [
        attach_row(train.agg(F.lit(i).alias("fold"), F.count("*").alias("train")), val.agg(F.count("*").alias("validation")))
        for i, (train, val) in enumerate(folds)
    ]
    return union_all_of(counts)


@query("f18_repartition_coalesce")
def f18(t):
    wide = t.orders.select("o_orderkey").repartition(12)
    narrow = wide.coalesce(3).withColumn("part", F.spark_partition_id())
    return narrow.groupBy("part").agg(F.count("*").alias("n"))


@query("f19_partition_by_key_function")
def f19(t):
    rows = t.orders.select("o_custkey").repartition(6, F.col("o_custkey") % 6).withColumn("part", F.spark_partition_id())
    return rows.groupBy("part", (F.col("o_custkey") % 6).alias("k")).agg(F.count("*").alias("n"))


@query("f20_range_partitioning")
def f20(t):
    rows = t.orders.repartitionByRange(8, "o_totalprice").withColumn("part", F.spark_partition_id())
    return rows.groupBy("part").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("f21_partition_pruning")
def f21(t):
    rows = t.lineitem.select("l_orderkey").repartition(8, "l_orderkey").withColumn("part", F.spark_partition_id())
    return rows.filter("part < 3").groupBy("part").agg(F.count("*").alias("n"))


@query("f22_union_all_method", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def f22(t):
    return t.region.select(F.col("r_name").alias("name")).unionAll(t.nation.select("n_name"))


query("f23_except_method", _EXCEPT)(_except)


@query("f24_intersect_method", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def f24(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("f25_sample_method")
def f25(t):
    return t.part.sample(fraction=0.3, seed=2).select("p_partkey")


@query(
    "f26_union_of_many",
    """SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey FROM supplier
       UNION ALL SELECT p_partkey FROM part UNION ALL SELECT doc_id FROM documents""",
)
def f26(t):
    frames = [t.customer.select("c_custkey"), t.supplier.select("s_suppkey"), t.part.select("p_partkey"), t.documents.select("doc_id")]
    return union_all_of([f.toDF("id") for f in frames])


@query("f27_partition_aware_union")
def f27(t):
    """Both inputs hashed alike; the grouped count over the union keeps that partitioning."""
    a = t.orders.select(F.col("o_custkey").alias("k")).repartition(8, "k")
    b = t.events.select(F.col("user_id").alias("k")).repartition(8, "k")
    return a.unionAll(b).groupBy("k").agg(F.count("*").alias("n"))


@query("f28_unit_range_sample")
def f28(t):
    rows = t.orders.select("o_orderkey")
    inside = unit_range_sample(rows, 0.2, 0.5, 8).agg(F.lit("inside").alias("side"), F.count("*").alias("n"))
    return inside.unionAll(unit_range_sample(rows, 0.2, 0.5, 8, complement=True).agg(F.lit("outside"), F.count("*")))


@query("f29_poisson_sample")
def f29(t):
    return t.customer.select("c_custkey").sample(True, 1.5, 31)


@query("f30_reservoir_per_partition")
def f30(t):
    return reservoir_per_partition(t.orders.select("o_orderkey", "o_totalprice"), 10, 7)


@query("f31_repartition")
def f31(t):
    rows = t.customer.repartition(5).withColumn("part", F.spark_partition_id())
    return rows.groupBy("part").agg(F.count("*").alias("n"))
