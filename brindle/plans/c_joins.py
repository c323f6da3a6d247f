"""Joins."""

from pyspark.sql import functions as F

from brindle.operators.grouping import cogroup
from brindle.operators.relational import bounded_cross, broadcast_if_small, range_join, salted_join
from brindle.registry import query, sql_query

_SIDES = "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"

sql_query(
    "c1_inner_join",
    """SELECT o_orderpriority, c_mktsegment, COUNT(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey
       GROUP BY o_orderpriority, c_mktsegment""",
)


@query(
    "c2_shuffled_hash_join",
    """SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS qty
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""",
)
def c2(t):
    joined = t.lineitem.join(t.orders.hint("shuffle_hash"), F.expr("l_orderkey = o_orderkey"))
    qty = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), qty.alias("qty"))


@query("c3_broadcast_hash_join", "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def c3(t):
    nations = broadcast_if_small(t.nation, 10_000)
    return t.customer.join(nations, F.expr("c_nationkey = n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


_BIG = "(SELECT o_custkey AS k, MAX(o_totalprice) AS p FROM {orders} GROUP BY o_custkey) a"
_SEG = "(SELECT c_custkey AS k, c_mktsegment AS s FROM {customer}) b"
for _slug, _kind in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL OUTER")):
    sql_query(
        f"c4_{_slug}_outer_join_with_condition",
        f"""SELECT coalesce(a.k, -1) AS ka, coalesce(b.k, -1) AS kb, coalesce(p, -1) AS p, coalesce(s, '-') AS s
            FROM {_BIG} {_kind} JOIN {_SEG} ON a.k = b.k AND s <> 'BUILDING'""",
    )
sql_query(
    "c5_left_semi_join",
    "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 490000",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 490000)",
)
sql_query(
    "c6_left_semi_non_equi",
    """SELECT s_suppkey FROM {supplier} LEFT SEMI JOIN (SELECT c_nationkey, MAX(c_acctbal) AS top FROM {customer} GROUP BY 1) x
       ON s_nationkey = c_nationkey AND s_acctbal < top - 9000""",
    """SELECT s_suppkey FROM supplier WHERE EXISTS
       (SELECT 1 FROM customer WHERE s_nationkey = c_nationkey AND s_acctbal < c_acctbal - 9000)""",
)


@query(
    "c7_theta_join_range",
    """SELECT nation, COUNT(*) AS n FROM customer JOIN
       (SELECT s_nationkey AS nation, MIN(s_acctbal) AS low, MAX(s_acctbal) AS high FROM supplier GROUP BY 1) r
       ON c_acctbal >= low AND c_acctbal < high GROUP BY nation""",
)
def c7(t):
    ranges = t.supplier.groupBy(F.col("s_nationkey").alias("nation"))
    ranges = ranges.agg(F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))
    pairs = range_join(t.customer.select("c_custkey", "c_acctbal"), ranges, "c_acctbal", "low", "high", 500.0)
    return pairs.groupBy("nation").agg(F.count("*").alias("n"))


sql_query(
    "c7_theta_join_outer",
    """SELECT r_name, coalesce(n_name, '-') AS n_name FROM {region}
       LEFT JOIN {nation} ON n_regionkey < r_regionkey""",
)


@query(
    "c8_cartesian_product",
    """SELECT c_mktsegment, n_name, segment_n * 100 + nation_n AS score FROM
       (SELECT c_mktsegment, COUNT(*) AS segment_n FROM customer GROUP BY 1) a CROSS JOIN
       (SELECT n_name, COUNT(*) AS nation_n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) b""",
)
def c8(t):
    """Both sides are aggregates over small domains; the bound of the right one is checked."""
    a = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("segment_n"))
    b = t.supplier.join(t.nation, F.expr("s_nationkey = n_nationkey")).groupBy("n_name").agg(F.count("*").alias("nation_n"))
    pairs = bounded_cross(a, b, 1000)
    return pairs.select("c_mktsegment", "n_name", (F.col("segment_n") * 100 + F.col("nation_n")).alias("score"))


sql_query("c9_comma_join", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey")
sql_query(
    "c10_cross_join_keyword",
    """SELECT s_suppkey, round(s_acctbal / total, 9) AS share FROM {supplier} CROSS JOIN
       (SELECT CAST(SUM(CAST(s_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM {supplier}) x""",
)


@query(
    "c11_multi_key_join_with_residual",
    """SELECT l.l_orderkey, l.l_linenumber, r.l_partkey AS other_part FROM lineitem l JOIN lineitem r
       ON l.l_orderkey = r.l_orderkey AND l.l_suppkey = r.l_suppkey AND l.l_extendedprice < r.l_extendedprice""",
)
def c11(t):
    cols = ["l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    a, b = t.lineitem.select(cols).alias("a"), t.lineitem.select(cols).alias("b")
    on = F.expr("a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_extendedprice < b.l_extendedprice")
    return a.join(b, on).select("a.l_orderkey", "a.l_linenumber", F.col("b.l_partkey").alias("other_part"))


sql_query(
    "c12_self_join",
    """SELECT a.o_orderkey AS first, b.o_orderkey AS second FROM {orders} a JOIN {orders} b
       ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey""",
)


@query("c13_keyed_inner_join", _SIDES)
def c13(t):
    left = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey")
    right = t.customer.select(F.col("c_custkey").alias("k"), "c_name")
    return left.join(right, "k").withColumnRenamed("k", "o_custkey")


def _keyed(t):
    """Lines per quantity against nations by key: both sides hold keys the other lacks."""
    left = t.lineitem.groupBy(F.col("l_quantity").cast("int").alias("k")).agg(F.count("*").alias("lines"))
    return left, t.nation.select(F.col("n_nationkey").alias("k"), "n_name")


def _keyed_sql(kind):
    return f"""SELECT k, coalesce(lines, -1) AS s, coalesce(n_name, '-') AS n FROM
               (SELECT l_quantity::INTEGER AS k, COUNT(*) AS lines FROM lineitem GROUP BY 1) a {kind} JOIN
               (SELECT n_nationkey AS k, n_name FROM nation) b USING (k)"""


def _keyed_join(how):
    def run(t):
        left, right = _keyed(t)
        joined = left.join(right, "k", how)
        return joined.select("k", F.coalesce("lines", F.lit(-1)).alias("s"), F.coalesce("n_name", F.lit("-")).alias("n"))

    return run


query("c14_keyed_left_outer_join", _keyed_sql("LEFT"))(_keyed_join("left"))
query("c15_keyed_right_outer_join", _keyed_sql("RIGHT"))(_keyed_join("right"))
query("c25_full_outer_join", _keyed_sql("FULL"))(_keyed_join("full"))


def _csv(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@query(
    "c16_cogroup_three",
    """SELECT k, 0::BIGINT AS chunk, coalesce(o, '') AS orders, coalesce(e, '') AS events, coalesce(c, '') AS names FROM
       (SELECT o_custkey AS k, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS o FROM orders GROUP BY 1)
       FULL JOIN (SELECT user_id AS k, string_agg(event_id, ',' ORDER BY event_id) AS e FROM events GROUP BY 1) USING (k)
       FULL JOIN (SELECT c_custkey AS k, string_agg(c_name, ',' ORDER BY c_name) AS c FROM customer GROUP BY 1) USING (k)""",
)
def c16(t):
    grouped = cogroup(
        "k",
        {
            "orders": (t.orders.withColumn("k", F.col("o_custkey")), F.col("o_orderkey")),
            "events": (t.events.withColumn("k", F.col("user_id")), F.col("event_id")),
            "names": (t.customer.withColumn("k", F.col("c_custkey")), F.col("c_name")),
        },
    )
    return grouped.select("k", "chunk", _csv("orders").alias("orders"), _csv("events").alias("events"), _csv("names").alias("names"))


@query(
    "c17_group_with",
    """SELECT k, 0::BIGINT AS chunk, coalesce(c, '') AS customers, coalesce(s, '') AS suppliers FROM
       (SELECT c_nationkey AS k, string_agg(c_custkey, ',' ORDER BY c_custkey) AS c FROM customer GROUP BY 1)
       FULL JOIN (SELECT s_nationkey AS k, string_agg(s_suppkey, ',' ORDER BY s_suppkey) AS s FROM supplier GROUP BY 1) USING (k)""",
)
def c17(t):
    grouped = cogroup(
        "k",
        {
            "customers": (t.customer.withColumn("k", F.col("c_nationkey")), F.col("c_custkey")),
            "suppliers": (t.supplier.withColumn("k", F.col("s_nationkey")), F.col("s_suppkey")),
        },
    )
    return grouped.select("k", "chunk", _csv("customers").alias("customers"), _csv("suppliers").alias("suppliers"))


@query(
    "c18_subtract_by_key",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
)
def c18(t):
    users = t.events.select(F.col("user_id").alias("c_custkey"))
    return t.customer.select("c_custkey").join(users, "c_custkey", "left_anti")


@query("c19_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 77")
def c19(t):
    return t.orders.filter(F.col("o_custkey") == 77).select("o_orderkey", "o_totalprice")


@query("c20_cartesian", "SELECT s_suppkey, r_name FROM supplier CROSS JOIN region")
def c20(t):
    return bounded_cross(t.supplier.select("s_suppkey"), t.region.select("r_name"), 100)


@query(
    "c21_map_side_join",
    "SELECT l_returnflag, p_type, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
)
def c21(t):
    """The lookup side is broadcast only while a row count proves it small; beyond that the join shuffles."""
    lookup = broadcast_if_small(t.part.select("p_partkey", "p_type"), 500_000)
    return t.lineitem.join(lookup, F.expr("l_partkey = p_partkey")).groupBy("l_returnflag", "p_type").agg(F.count("*").alias("n"))


@query(
    "c22_join_keeping_unmatched",
    """SELECT c_custkey, coalesce(total, c_acctbal) AS attr FROM customer LEFT JOIN
       (SELECT user_id, MAX(value) AS total FROM events GROUP BY 1) ON c_custkey = user_id""",
)
def c22(t):
    new = t.events.groupBy("user_id").agg(F.max("value").alias("total"))
    joined = t.customer.join(new, F.expr("c_custkey = user_id"), "left")
    return joined.select("c_custkey", F.coalesce("total", "c_acctbal").alias("attr"))


sql_query(
    "c23_map_join_hint",
    """SELECT /*+ MAPJOIN(r) */ r_name, COUNT(*) AS n FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey
       GROUP BY r_name""",
    "SELECT r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
sql_query(
    "c24_left_semi_join_keyword",
    "SELECT p_partkey, p_name FROM {part} LEFT SEMI JOIN {lineitem} ON p_partkey = l_partkey AND l_quantity = 50",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
)


@query(
    "c13_skewed_join_salted",
    """SELECT n_name, COUNT(*) AS n, SUM(l_linenumber)::BIGINT AS lines FROM lineitem
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def c13_skew(t):
    """The big side may hold a third of its rows under one supplier."""
    lines = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_linenumber")
    joined = salted_join(lines, t.supplier.select("s_suppkey", "s_nationkey"), ["s_suppkey"])
    joined = joined.join(t.nation, F.expr("s_nationkey = n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))
