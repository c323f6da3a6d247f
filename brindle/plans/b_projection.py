"""Projection, filters, predicates and record-wise operators."""

import pandas as pd
from pyspark.sql import functions as F

from brindle.operators.ordered import zip_frames, zip_with_index
from brindle.operators.relational import auto_alias
from brindle.registry import query, sql_query

# --- select lists and relations -------------------------------------------------------------


@query("b1_select_auto_names", "SELECT p_partkey, p_size + 1 AS c1, upper(p_name) AS c2 FROM part")
def b1(t):
    return auto_alias(t.part, "p_partkey", F.col("p_size") + 1, F.upper("p_name"))


sql_query("b2_star_expansion", "SELECT n.*, r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")
sql_query("b3_column_alias", "SELECT s_suppkey AS id, s_acctbal * 2 AS twice FROM {supplier}")


@query(
    "b4_relation_alias_self_join",
    """SELECT a.c_custkey AS id, b.n_name AS nation, c.n_name AS first_of_region FROM customer a
       JOIN nation b ON a.c_nationkey = b.n_nationkey JOIN nation c ON b.n_regionkey = c.n_nationkey""",
)
def b4(t):
    b, c = t.nation.alias("b"), t.nation.alias("c")
    return (
        t.customer.alias("a")
        .join(b, F.expr("a.c_nationkey = b.n_nationkey"))
        .join(c, F.expr("b.n_regionkey = c.n_nationkey"))
        .select(
            F.col("a.c_custkey").alias("id"), F.col("b.n_name").alias("nation"), F.col("c.n_name").alias("first_of_region")
        )
    )


sql_query(
    "b5_derived_table",
    """SELECT status, n FROM (SELECT o_orderstatus AS status, COUNT(*) AS n FROM {orders} GROUP BY o_orderstatus) x
       WHERE n > 10""",
)
sql_query("b6_select_without_from", "SELECT r_name, x.two FROM {region} CROSS JOIN (SELECT 1 + 1 AS two) x")

# --- filters -------------------------------------------------------------------------------

sql_query("b7_filter_expression", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 400000")


@query("b8_filter_column_function", "SELECT p_partkey, p_size FROM part WHERE p_size * 3 > 60")
def b8(t):
    @F.pandas_udf("boolean")
    def keep(size: pd.Series) -> pd.Series:
        return size * 3 > 60

    return t.part.select("p_partkey", "p_size").filter(keep("p_size"))


@query("b9_filter_row_function", "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 100 * c_nationkey")
def b9(t):
    def keep(batches):
        for rows in batches:
            yield rows.loc[rows.c_acctbal > 100 * rows.c_nationkey, ["c_custkey", "c_nationkey"]]

    return t.customer.select("c_custkey", "c_nationkey", "c_acctbal").mapInPandas(keep, "c_custkey long, c_nationkey int")


sql_query(
    "b10_having",
    "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING MAX(o_totalprice) > 490000 AND COUNT(*) > 3",
)


@query("b10_having_without_group", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000")
def b10_plain(t):
    """HAVING without GROUP BY is a plain filter in the warehouse dialect; here it is written as one."""
    return t.supplier.select("s_suppkey", "s_acctbal").where("s_acctbal > 5000")


_NULLS = "(SELECT p_partkey, nullif(p_size % 3, 0) AS a, nullif(p_size % 2, 0) AS b FROM {part}) x"


def _flags(name, expr):
    sql_query(name, f"SELECT p_partkey, {expr} AS v FROM {_NULLS}", None)


def _text(flag):
    return f"CASE WHEN {flag} THEN 'true' WHEN NOT ({flag}) THEN 'false' ELSE 'null' END"


_flags("b11_and_three_valued", _text("a = 1 AND b = 1"))
_flags("b12_or_three_valued", _text("a = 1 OR b = 1"))
_flags("b13_not_three_valued", _text("NOT (a = 1)"))
_flags("b14_equals", _text("a = b"))


@query(
    "b15_null_safe_equals",
    f"SELECT p_partkey, (a IS NOT DISTINCT FROM b) AS v FROM {_NULLS}".replace("{part}", "part"),
)
def b15(t):
    a, b = F.expr("nullif(p_size % 3, 0)"), F.expr("nullif(p_size % 2, 0)")
    return t.part.select("p_partkey", a.eqNullSafe(b).alias("v"))


sql_query("b16_less_than", "SELECT l_returnflag, COUNT(*) AS n FROM {lineitem} WHERE l_discount < 0.05 GROUP BY l_returnflag")
sql_query("b17_less_or_equal", "SELECT l_returnflag, COUNT(*) AS n FROM {lineitem} WHERE l_quantity <= 10 GROUP BY l_returnflag")
sql_query("b18_greater_than", "SELECT l_returnflag, COUNT(*) AS n FROM {lineitem} WHERE l_quantity > 40 GROUP BY l_returnflag")
sql_query("b19_greater_or_equal", "SELECT l_returnflag, COUNT(*) AS n FROM {lineitem} WHERE l_tax >= 0.04 GROUP BY l_returnflag")
sql_query("b20_in_list", "SELECT p_partkey, p_type FROM {part} WHERE p_type IN ('PROMO', 'LARGE', 'none')")


@query(
    "b20_in_list_plain_membership",
    f"""SELECT p_partkey, (CASE WHEN a IS NULL THEN TRUE ELSE a = 1 END) AS v FROM {_NULLS}""".replace("{part}", "part"),
)
def b20_plain(t):
    """``a IN (null, 1)`` with plain membership: never null, null is a member."""
    a = F.expr("nullif(p_size % 3, 0)")
    return t.part.select("p_partkey", (a.eqNullSafe(F.lit(None)) | a.eqNullSafe(F.lit(1))).alias("v"))


sql_query(
    "b21_between",
    """SELECT o_orderkey, o_totalprice BETWEEN 100000 AND 200000 AS inside,
              o_totalprice NOT BETWEEN 50000 AND 450000 AS outside FROM {orders}""",
)
sql_query("b22_is_null", f"SELECT COUNT(*) AS n FROM {_NULLS} WHERE a IS NULL")
sql_query("b23_is_not_null", f"SELECT COUNT(*) AS n FROM {_NULLS} WHERE a IS NOT NULL AND b IS NOT NULL")


@query("b24_rand")
def b24(t):
    return t.orders.select("o_orderkey", F.rand(7).alias("r"))


# --- record-wise operators --------------------------------------------------------------------


@query("b25_map", "SELECT l_orderkey + l_linenumber AS k, round(l_quantity * l_tax, 6) AS v FROM lineitem")
def b25(t):
    return t.lineitem.select(
        (F.col("l_orderkey") + F.col("l_linenumber")).alias("k"), F.round(F.col("l_quantity") * F.col("l_tax"), 6).alias("v")
    )


@query(
    "b26_flat_map",
    "SELECT word, COUNT(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) x GROUP BY word",
)
def b26(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("b27_filter_records", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def b27(t):
    return t.orders.filter((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query(
    "b28_collect_partial_function",
    "SELECT event_id, value * 100 AS cents FROM events WHERE event_type = 'purchase'",
)
def b28(t):
    return t.events.filter("event_type = 'purchase'").select("event_id", (F.col("value") * 100).alias("cents"))


@query("b29_key_by", "SELECT c_nationkey % 5 AS key, c_custkey, c_name FROM customer")
def b29(t):
    return t.customer.withColumn("key", F.col("c_nationkey") % 5).select("key", "c_custkey", "c_name")


@query("b30_map_values", "SELECT s_nationkey AS k, s_acctbal + 1000 AS v FROM supplier")
def b30(t):
    pairs = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    return pairs.withColumn("v", F.col("v") + 1000)


@query(
    "b31_flat_map_values",
    "SELECT p_brand AS k, unnest(string_split(p_name, ' ')) AS v FROM part",
)
def b31(t):
    return t.part.select(F.col("p_brand").alias("k"), F.explode(F.split("p_name", " ")).alias("v"))


@query(
    "b32_keys_values",
    "SELECT 'key' AS part, o_custkey AS x FROM orders UNION ALL SELECT 'value', o_orderkey FROM orders",
)
def b32(t):
    pairs = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    keys = pairs.select(F.lit("key").alias("part"), F.col("k").alias("x"))
    return keys.unionAll(pairs.select(F.lit("value").alias("part"), F.col("v").alias("x")))


@query("b33_map_partitions", "SELECT p_partkey, p_size * p_size AS square FROM part")
def b33(t):
    def squares(batches):
        for rows in batches:
            yield pd.DataFrame({"p_partkey": rows.p_partkey, "square": rows.p_size**2})

    return t.part.select("p_partkey", "p_size").mapInPandas(squares, "p_partkey long, square int")


@query("b34_map_partitions_with_index")
def b34(t):
    def tag(batches):
        for rows in batches:
            yield rows.assign(low=rows.o_orderkey - rows.part)

    tagged = t.orders.select("o_orderkey", F.spark_partition_id().alias("part"))
    return tagged.mapInPandas(tag, "o_orderkey long, part int, low long").groupBy("part").agg(F.count("*").alias("n"))


@query("b35_map_partitions_with_context")
def b35(t):
    def with_context(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        for rows in batches:
            yield pd.DataFrame({"partition": [ctx.partitionId()], "attempt": [ctx.attemptNumber()], "n": [len(rows)]})

    return t.lineitem.select("l_orderkey").mapInPandas(with_context, "partition int, attempt int, n long")


@query("b36_map_with_partition_seed")
def b36(t):
    def noisy(batches):
        import numpy as np
        from pyspark import TaskContext

        rng = np.random.default_rng([42, TaskContext.get().partitionId()])
        for rows in batches:
            u = rng.random(len(rows))
            yield rows.assign(u=u)[u < 0.5]

    return t.events.select("event_id", "value").mapInPandas(noisy, "event_id long, value double, u double")


@query("b37_glom")
def b37(t):
    """One array per partition, built where the partition lies; no shuffle."""

    def one_array(batches):
        ids = [batch.c_custkey for batch in batches]
        if ids:
            yield pd.DataFrame({"ids": [pd.concat(ids).to_numpy()]})

    return t.customer.select("c_custkey").mapInPandas(one_array, "ids array<long>").select(F.size("ids").alias("n"), "ids")


@query("b38_pipe", "SELECT upper(p_name) AS line, COUNT(*) AS n FROM part GROUP BY 1")
def b38(t):
    lines = t.part.rdd.map(lambda r: r.p_name).pipe("tr a-z A-Z")
    return lines.map(lambda s: (s,)).toDF("line string").groupBy("line").agg(F.count("*").alias("n"))


@query("b39_script_transform", "SELECT o_orderkey, o_orderstatus AS status FROM orders")
def b39(t):
    return t.sql(
        """SELECT CAST(k AS BIGINT) AS o_orderkey, status
           FROM (SELECT TRANSFORM(o_orderkey, o_orderstatus) USING 'cat' AS (k STRING, status STRING) FROM {orders}) x"""
    )


@query("b40_zip_with_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders")
def b40(t):
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return zip_with_index(rows, [F.col("o_orderdate"), F.col("o_orderkey")], "i").drop("o_orderdate")


@query("b41_unique_id", "SELECT COUNT(*) AS n, COUNT(*) AS ids FROM orders")
def b41(t):
    rows = t.orders.withColumn("id", F.monotonically_increasing_id())
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query(
    "b42_zip",
    """SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS i FROM customer)
       JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) USING (i)""",
)
def b42(t):
    return zip_frames(
        t.customer.select("c_custkey"), t.supplier.select("s_suppkey"), [F.desc("c_custkey")], [F.col("s_suppkey")]
    )


@query(
    "b43_zip_partitions",
    """SELECT c_nationkey % 8 AS part, COUNT(DISTINCT c_custkey) AS customers, COUNT(DISTINCT s_suppkey) AS suppliers
       FROM customer FULL JOIN supplier ON c_nationkey % 8 = s_nationkey % 8 GROUP BY 1""",
)
def b43(t):
    """Equally partitioned frames combined part by part: partials first, then one row per part and side."""
    a = t.customer.groupBy((F.col("c_nationkey") % 8).alias("part")).agg(F.count("*").alias("customers"))
    b = t.supplier.groupBy((F.col("s_nationkey") % 8).alias("part")).agg(F.count("*").alias("suppliers"))

    def combine(left, right):
        left = left.set_index("part").customers
        right = right.set_index("part").suppliers
        both = pd.concat([left, right], axis=1).fillna(0).astype("int64")
        return both.reset_index()

    grouped = a.groupBy("part").cogroup(b.groupBy("part"))
    return grouped.applyInPandas(combine, "part int, customers long, suppliers long")


@query("b44_foreach_partition", "SELECT COUNT(*) AS rows_seen FROM supplier")
def b44(t):
    seen = t.spark.sparkContext.accumulator(0)

    def count(rows):
        seen.add(sum(1 for _ in rows))

    t.supplier.select("s_suppkey").foreachPartition(count)
    return t.region.limit(1).select(F.lit(seen.value).cast("long").alias("rows_seen"))


@query(
    "b45_expression_methods",
    """SELECT n_regionkey, MAX(n_nationkey * 2 + 1) AS top, MIN(-n_nationkey) AS low, COUNT(DISTINCT n_name) AS names
       FROM nation WHERE n_nationkey >= 3 AND NOT n_name LIKE '%_1' GROUP BY n_regionkey""",
)
def b45(t):
    c = F.col
    return (
        t.nation.where((c("n_nationkey") >= 3) & ~c("n_name").like("%_1"))
        .groupBy("n_regionkey")
        .agg(
            F.max(c("n_nationkey") * 2 + 1).alias("top"),
            F.min(-c("n_nationkey")).alias("low"),
            F.count_distinct("n_name").alias("names"),
        )
    )


@query(
    "b46_integer_preserving_string_cast",
    """SELECT c_custkey, TRY_CAST(trunc(TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN c_name
              ELSE CAST(c_custkey AS VARCHAR) || '.75' END AS DECIMAL(38, 10))) AS INTEGER) AS v FROM customer""",
)
def b46(t):
    text = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(".75")))
    return t.customer.select("c_custkey", text.try_cast("decimal(38,10)").try_cast("int").alias("v"))


@query(
    "b47_boolean_in_arithmetic",
    "SELECT l_returnflag, SUM(CAST(l_discount > 0.05 AS INTEGER) + 1)::BIGINT AS v FROM lineitem GROUP BY 1",
)
def b47(t):
    over = (F.col("l_discount") > 0.05).cast("int") + 1
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(over).alias("v"))


@query("b48_foreach_with_partition_state", "SELECT COUNT(*) AS rows_seen FROM customer")
def b48(t):
    seen = t.spark.sparkContext.accumulator(0)

    def walk(rows):
        import random

        from pyspark import TaskContext

        state = random.Random(TaskContext.get().partitionId())
        seen.add(sum(1 for _ in rows if state.random() >= 0.0))

    t.customer.select("c_custkey").foreachPartition(walk)
    return t.region.limit(1).select(F.lit(seen.value).cast("long").alias("rows_seen"))


@query("b49_row_count", "SELECT COUNT(*) AS n FROM lineitem")
def b49(t):
    return t.lineitem.agg(F.count("*").alias("n"))
