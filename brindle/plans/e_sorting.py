"""Sort, limit, top-k."""

from pyspark.sql import functions as F

from brindle.registry import query, sql_query

sql_query(
    "e1_order_by",
    """SELECT o_orderkey, nullif(o_custkey % 5, 0) AS k FROM {orders}
       ORDER BY nullif(o_custkey % 5, 0) ASC NULLS FIRST, o_orderkey DESC""",
)


@query(
    "e2_null_order_and_direction",
    """SELECT p_partkey, coalesce(k, -1) AS k FROM (SELECT p_partkey, nullif(p_size % 4, 0) AS k FROM part
       ORDER BY k DESC NULLS FIRST, p_partkey) x""",
)
def e2(t):
    rows = t.part.select("p_partkey", F.expr("nullif(p_size % 4, 0)").alias("k"))
    return rows.orderBy(F.col("k").desc_nulls_first(), "p_partkey").withColumn("k", F.coalesce("k", F.lit(-1)))


@query("e3_order_by_expression", "SELECT p_partkey, p_size FROM part ORDER BY p_size % 7, p_retailprice DESC, p_partkey")
def e3(t):
    return t.part.orderBy(F.col("p_size") % 7, F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_size")


sql_query("e4_order_by_hidden_column", "SELECT c_name FROM {customer} ORDER BY c_acctbal DESC, c_custkey")


@query("e5_sort_by")
def e5(t):
    """Ascending within each of the partitions; checked per partition in the tests."""
    return t.orders.select("o_orderkey", "o_totalprice").sortWithinPartitions("o_totalprice").withColumn(
        "part", F.spark_partition_id()
    )


@query("e6_distribute_by")
def e6(t):
    return t.orders.select("o_custkey", "o_orderkey").repartition("o_custkey").withColumn("part", F.spark_partition_id())


@query("e7_cluster_by")
def e7(t):
    rows = t.orders.select("o_custkey", "o_orderkey")
    return rows.repartition("o_custkey").sortWithinPartitions("o_custkey").withColumn("part", F.spark_partition_id())


sql_query("e8_limit", "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM {orders} LIMIT 10) x")
sql_query("e9_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")


@query("e10_sort_by_key_function", "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal), c_custkey")
def e10(t):
    return t.customer.orderBy(F.abs("c_acctbal"), "c_custkey").select("c_custkey")


@query("e11_range_partitioned_sort", "SELECT COUNT(*) AS n, 0::BIGINT AS out_of_order FROM orders")
def e11(t):
    """Range partitions sorted inside: every partition ends before the next begins."""
    from brindle.operators.ordered import sliding

    rows = t.orders.select("o_orderkey", "o_totalprice")
    pairs = sliding(rows, [F.col("o_totalprice"), F.col("o_orderkey")], 2, F.col("o_totalprice"), "w")
    return pairs.agg(
        (F.count("*") + 1).alias("n"), F.sum((F.col("w")[0] > F.col("w")[1]).cast("long")).alias("out_of_order")
    )


@query("e12_take_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
def e12(t):
    return t.orders.orderBy("o_orderkey").limit(7).select("o_orderkey")


@query("e13_take_ordered", "SELECT l_extendedprice AS v FROM lineitem ORDER BY v LIMIT 12")
def e13(t):
    return t.lineitem.select(F.col("l_extendedprice").alias("v")).orderBy("v").limit(12)


@query("e14_top", "SELECT l_extendedprice AS v FROM lineitem ORDER BY v DESC LIMIT 12")
def e14(t):
    return t.lineitem.select(F.col("l_extendedprice").alias("v")).orderBy(F.desc("v")).limit(12)


@query("e15_limit_method", "SELECT COUNT(*) AS n FROM (SELECT 1 FROM lineitem LIMIT 33) x")
def e15(t):
    return t.lineitem.select("l_orderkey").limit(33).agg(F.count("*").alias("n"))


@query("e16_table_take", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5")
def e16(t):
    return t.part.orderBy("p_partkey").limit(5).select("p_partkey", "p_name")
