"""Aggregates, folds, histograms and bounded estimates."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from brindle.operators.approx import approx_count, approx_mean, approx_sum
from brindle.operators.grouping import fold_by_key, group_lists, tree_aggregate
from brindle.operators.histogram import bound_histogram, even_histogram
from brindle.operators.relational import attach_row
from brindle.registry import query, sql_query


def _money(col, digits=2):
    """Exact sum of a double that carries a fixed number of decimals."""
    return F.sum(F.col(col).cast(f"decimal(18,{digits})")).cast("double")


def _msql(col, digits=2):
    return f"CAST(SUM(CAST({col} AS DECIMAL(18, {digits}))) AS DOUBLE)"


sql_query(
    "d1_group_by_expression",
    "SELECT p_size % 10 AS k, COUNT(*) AS n, MAX(p_retailprice) AS top FROM {part} GROUP BY p_size % 10",
)
sql_query("d2_global_aggregate", "SELECT COUNT(*) AS n, MIN(l_shipdate) = MAX(l_shipdate) AS same, MAX(l_quantity) AS q FROM {lineitem}")


@query(
    "d3_two_phase_hash_aggregate",
    f"SELECT l_suppkey, COUNT(*) AS n, {_msql('l_extendedprice')} AS price FROM lineitem GROUP BY l_suppkey",
)
def d3(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), _money("l_extendedprice").alias("price"))


sql_query("d4_count", "SELECT event_type, COUNT(*) AS n, COUNT(nullif(user_id % 4, 0)) AS some FROM {events} GROUP BY event_type")


@query(
    "d5_count_distinct_many",
    """SELECT event_type, COUNT(*) AS n FROM (SELECT DISTINCT event_type, nullif(user_id % 10, 0) AS a, floor(value / 100) AS b
       FROM events) x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY event_type""",
)
def d5(t):
    return t.sql(
        "SELECT event_type, COUNT(DISTINCT nullif(user_id % 10, 0), floor(value / 100)) AS n FROM {events} GROUP BY event_type"
    )


@query("d6_approximate_count_distinct")
def d6(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("n"))


sql_query(
    "d7_sum",
    """SELECT l_linestatus, CAST(SUM(l_linenumber) AS BIGINT) AS lines,
              CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price FROM {lineitem} GROUP BY l_linestatus""",
)


@query("d7_sum_overflow_safe", "SELECT CAST(SUM(CAST(o_orderkey AS HUGEINT) * 1000000007) AS VARCHAR) AS total FROM orders")
def d7_wide(t):
    wide = F.col("o_orderkey").cast("decimal(28,0)") * F.lit(1000000007).cast("decimal(10,0)")
    return t.orders.agg(F.sum(wide.cast("decimal(28,0)")).cast("string").alias("total"))


sql_query("d8_sum_distinct", "SELECT l_returnflag, CAST(SUM(DISTINCT l_quantity) AS DOUBLE) AS v FROM {lineitem} GROUP BY l_returnflag")


@query("d9_avg", f"SELECT o_orderstatus, {_msql('o_totalprice')} / COUNT(*) AS v FROM orders GROUP BY o_orderstatus")
def d9(t):
    return t.orders.groupBy("o_orderstatus").agg((_money("o_totalprice") / F.count("*")).alias("v"))


sql_query("d9_avg_plain", "SELECT l_returnflag, round(AVG(l_quantity), 6) AS v FROM {lineitem} GROUP BY l_returnflag")
sql_query("d10_min", "SELECT o_custkey, MIN(o_totalprice) AS v, MIN(o_orderpriority) AS p FROM {orders} GROUP BY o_custkey")
sql_query("d11_max", "SELECT o_custkey, MAX(o_totalprice) AS v, MAX(o_orderpriority) AS p FROM {orders} GROUP BY o_custkey")


@query(
    "d12_first",
    "SELECT user_id, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id",
)
def d12(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"))


@query(
    "d13_widened_sum_avg",
    "SELECT SUM(p_size)::BIGINT AS total, round(AVG(p_size), 9) AS mean FROM part",
)
def d13(t):
    return t.part.agg(F.sum("p_size").alias("total"), F.round(F.avg("p_size"), 9).alias("mean"))


sql_query("d14_empty_input_global", "SELECT COUNT(*) AS n, coalesce(MAX(o_totalprice), -1) AS top FROM {orders} WHERE o_totalprice < 0")
sql_query(
    "d14_empty_input_grouped",
    """SELECT 'groups' AS what, COUNT(*) AS n FROM
       (SELECT o_orderstatus, COUNT(*) AS n FROM {orders} WHERE o_totalprice < 0 GROUP BY o_orderstatus) x""",
)
sql_query("d15_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")


@query("d16_distinct_records", "SELECT DISTINCT p_brand, p_type FROM part")
def d16(t):
    return t.part.select("p_brand", "p_type").distinct()


# --- folds -------------------------------------------------------------------------------


@query("d17_reduce", "SELECT p_name AS longest FROM part ORDER BY length(p_name) DESC, p_name LIMIT 1")
def d17(t):
    """Reduce by "the longer name wins, then the smaller": partials per batch, then a merge per level."""

    def longest(rows):
        best = rows.assign(n=rows.longest.str.len()).sort_values(["n", "longest"], ascending=[False, True])
        return best[["longest"]].head(1)

    return fold_by_key(t.part.select(F.col("p_name").alias("longest")), [], longest, "longest string")


@query("d18_fold", "SELECT COUNT(*) AS n, SUM(l_linenumber * l_linenumber)::BIGINT AS squares FROM lineitem")
def d18(t):
    rows = t.lineitem.select(F.lit(1).cast("long").alias("n"), (F.col("l_linenumber") ** 2).cast("long").alias("squares"))
    return fold_by_key(rows, [], lambda p: p.sum().to_frame().T.astype("int64"), "n long, squares long")


@query("d19_aggregate", "SELECT SUM(o_custkey)::BIGINT AS total, COUNT(*) AS n FROM orders")
def d19(t):
    return t.orders.agg(F.sum("o_custkey").alias("total"), F.count("*").alias("n"))


@query("d20_tree_reduce", "SELECT MAX(o_totalprice) AS top FROM orders")
def d20(t):
    return tree_aggregate(t.orders, [F.max("o_totalprice").alias("top")], [F.max("top").alias("top")], depth=3)


@query("d21_tree_aggregate", "SELECT COUNT(*) AS n, SUM(l_linenumber)::BIGINT AS lines, MIN(l_shipdate)::VARCHAR AS first FROM lineitem")
def d21(t):
    out = tree_aggregate(
        t.lineitem,
        [F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"), F.min("l_shipdate").alias("first")],
        [F.sum("n").alias("n"), F.sum("lines").alias("lines"), F.min("first").alias("first")],
    )
    return out.withColumn("first", F.date_format("first", "yyyy-MM-dd HH:mm:ss"))


@query("d22_count", "SELECT COUNT(*) AS n FROM events")
def d22(t):
    return t.events.agg(F.count("*").alias("n"))


@query("d23_count_by_value", "SELECT p_type, p_size, COUNT(*) AS n FROM part GROUP BY ALL")
def d23(t):
    rows = t.part.select("p_type", "p_size")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("d24_count_by_key", "SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY 1")
def d24(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("d25_count_approx")
def d25(t):
    return approx_count(t.lineitem, fraction=0.1, seed=1)


@query("d26_count_by_value_approx")
def d26(t):
    return approx_count(t.lineitem, ["l_returnflag", "l_linestatus"], fraction=0.1, seed=1)


@query("d27_count_by_key_approx")
def d27(t):
    return approx_count(t.events, ["event_type"], fraction=0.2, seed=2)


@query("d28_count_approx_distinct")
def d28(t):
    return t.lineitem.agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", F.lit(12))).alias("n"))


@query("d29_count_approx_distinct_by_key")
def d29(t):
    return t.lineitem.groupBy("l_linestatus").agg(F.approx_count_distinct("l_orderkey", 0.05).alias("n"))


@query(
    "d30_combine_by_key",
    "SELECT o_custkey, SUM(o_orderkey)::BIGINT AS total, COUNT(*) AS n FROM orders GROUP BY 1",
)
def d30(t):
    """General combiner: a function over frames of (key, total, n), partial per batch, merged by key."""

    def combine(rows):
        return rows.groupby("o_custkey", as_index=False)[["total", "n"]].sum()

    rows = t.orders.select("o_custkey", F.col("o_orderkey").alias("total"), F.lit(1).cast("long").alias("n"))
    return fold_by_key(rows, ["o_custkey"], combine, "o_custkey long, total long, n long")


@query(
    "d31_aggregate_by_key",
    "SELECT user_id, MAX(value) AS top, COUNT(*) AS n, COUNT(DISTINCT event_type) AS kinds FROM events GROUP BY 1",
)
def d31(t):
    return t.events.groupBy("user_id").agg(
        F.max("value").alias("top"), F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds")
    )


@query("d32_fold_by_key", "SELECT l_returnflag, bit_xor(l_orderkey) AS x FROM lineitem GROUP BY 1")
def d32(t):
    def xor(rows):
        import numpy as np

        return rows.groupby("l_returnflag", as_index=False).agg(x=("x", np.bitwise_xor.reduce))

    rows = t.lineitem.select("l_returnflag", F.col("l_orderkey").alias("x"))
    return fold_by_key(rows, ["l_returnflag"], xor, "l_returnflag string, x long")


@query("d33_reduce_by_key", f"SELECT l_orderkey, {_msql('l_extendedprice')} AS v FROM lineitem GROUP BY 1")
def d33(t):
    return t.lineitem.groupBy("l_orderkey").agg(_money("l_extendedprice").alias("v"))


@query("d34_reduce_by_key_locally", "SELECT p_brand, SUM(p_size)::BIGINT AS v FROM part GROUP BY 1")
def d34(t):
    return t.part.groupBy("p_brand").agg(F.sum("p_size").alias("v"))


def _csv(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@query(
    "d35_group_by_key",
    "SELECT o_custkey, 0 AS chunk, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1",
)
def d35(t):
    lists = group_lists(t.orders, "o_custkey", F.col("o_orderkey"), "orders")
    return lists.withColumn("orders", _csv("orders"))


@query(
    "d36_group_by_function",
    """SELECT p_partkey % 100 AS k, 0 AS chunk, string_agg(p_partkey || ':' || p_name, ',' ORDER BY p_partkey) AS items
       FROM part GROUP BY 1""",
)
def d36(t):
    rows = t.part.withColumn("k", F.col("p_partkey") % 100)
    lists = group_lists(rows, "k", F.struct("p_partkey", "p_name"), "items")
    items = F.transform("items", lambda s: F.concat_ws(":", s["p_partkey"].cast("string"), s["p_name"]))
    return lists.select("k", "chunk", F.array_join(items, ",").alias("items"))


@query("d37_collect_as_map")
def d37(t):
    """The map is over nations, a domain of fixed size, after counting the customers of each."""
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("c_nationkey", "n"))).alias("by_nation"))


# --- numeric summaries -----------------------------------------------------------------------


@query("d38_sum", f"SELECT {_msql('o_totalprice')} AS v FROM orders")
def d38(t):
    return t.orders.agg(_money("o_totalprice").alias("v"))


@query(
    "d39_stats",
    """SELECT COUNT(value) AS n, round(AVG(value), 6) AS mean, round(var_pop(value), 4) AS var, MIN(value) AS low,
              MAX(value) AS high FROM events""",
)
def d39(t):
    return t.events.agg(
        F.count("value").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.var_pop("value"), 4).alias("var"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


@query("d40_mean", "SELECT round(AVG(c_acctbal), 6) AS v FROM customer")
def d40(t):
    return t.customer.agg(F.round(F.avg("c_acctbal"), 6).alias("v"))


def _spread(row, slug, fn):
    @query(f"{row}_{slug}", f"SELECT l_returnflag, round({fn}(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1")
    def run(t):
        return t.lineitem.groupBy("l_returnflag").agg(F.round(getattr(F, fn)("l_extendedprice"), 2).alias("v"))


_spread("d41", "variance_population", "var_pop")
_spread("d42", "variance_sample", "var_samp")
_spread("d59", "stdev_population", "stddev_pop")
_spread("d60", "stdev_sample", "stddev_samp")


@query("d43_mean_approx")
def d43(t):
    return approx_mean(t.lineitem, "l_quantity", fraction=0.1, seed=3)


@query("d44_grouped_mean_approx")
def d44(t):
    return approx_mean(t.lineitem, "l_quantity", ["l_returnflag"], fraction=0.1, seed=3)


@query(
    "d45_histogram_even",
    """WITH b AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders),
       c AS (SELECT least(floor((o_totalprice - lo) * 20 / (hi - lo)), 19)::INTEGER AS bucket, COUNT(*) AS n
             FROM orders, b GROUP BY 1)
       SELECT i::INTEGER AS bucket, coalesce(n, 0) AS n, round(lo + (hi - lo) * i / 20, 4) AS low
       FROM range(20) r(i) CROSS JOIN b LEFT JOIN c ON bucket = i""",
)
def d45(t):
    return even_histogram(t.orders, "o_totalprice", 20).select("bucket", "n", F.round("low", 4).alias("low"))


@query(
    "d46_histogram_bounds",
    """SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 10.0::DOUBLE), (2, 25.0::DOUBLE), (3, 49.0::DOUBLE)) v(bucket, low) JOIN
       (SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity < 49 THEN 2 ELSE 3 END AS bucket,
               COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1) USING (bucket)""",
)
def d46(t):
    return bound_histogram(t.lineitem, "l_quantity", [0, 10, 25, 49, 50]).select("bucket", "low", "n")


@query(
    "d47_min_max_by_ordering",
    """SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1) AS top,
              (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS low""",
)
def d47(t):
    row = F.struct("o_totalprice", "o_orderkey")
    both = t.orders.agg(F.max(row).alias("a"), F.min(row).alias("b"))
    return both.select(F.col("a.o_orderkey").alias("top"), F.col("b.o_orderkey").alias("low"))


@query("d48_accumulators", "SELECT event_type, COUNT(*) AS n, (SELECT COUNT(*) FROM events WHERE value > 100) AS over_100 FROM events GROUP BY 1")
def d48(t):
    seen = Observation("counters")
    watched = t.events.observe(seen, F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).alias("over_100"))
    counts = watched.groupBy("event_type").agg(F.count("*").alias("n"))
    counts = counts.persist()
    counts.count()
    return counts.withColumn("over_100", F.lit(seen.get["over_100"]).cast("long"))


@query("d49_aggregate_by_name", "SELECT p_type, round(kurtosis_pop(p_size), 6) AS k, round(skewness_pop, 6) AS s FROM (SELECT p_type, p_size FROM part) x JOIN (SELECT p_type, SUM(power(p_size - m, 3)) / COUNT(*) / power(sqrt(SUM(power(p_size - m, 2)) / COUNT(*)), 3) AS skewness_pop FROM part JOIN (SELECT p_type, AVG(p_size) AS m FROM part GROUP BY 1) USING (p_type) GROUP BY 1) USING (p_type) GROUP BY p_type, skewness_pop")
def d49(t):
    """Aggregates resolved by their registered name."""
    by_name = [F.round(F.call_function(f, "p_size"), 6).alias(a) for f, a in (("kurtosis", "k"), ("skewness", "s"))]
    return t.part.groupBy("p_type").agg(*by_name)


@query("d50_distinct_through_sets", "SELECT p_brand, COUNT(DISTINCT p_type) AS n FROM part GROUP BY 1")
def d50(t):
    """Sets of part types: a domain of six."""
    return t.part.groupBy("p_brand").agg(F.size(F.collect_set("p_type")).cast("long").alias("n"))


@query("d51_union_of_partial_sets", "SELECT COUNT(DISTINCT p_brand) AS n FROM part")
def d51(t):
    """Brands: a small domain; partial sets per type, then their union."""
    sets = t.part.groupBy("p_type").agg(F.collect_set("p_brand").alias("s"))
    return sets.agg(F.size(F.array_distinct(F.flatten(F.collect_list("s")))).cast("long").alias("n"))


@query("d52_sketch_partitions")
def d52(t):
    return t.events.groupBy("event_type").agg(F.hll_sketch_agg("user_id", F.lit(12)).alias("sketch")).select(
        "event_type", F.hll_sketch_estimate("sketch").alias("n")
    )


@query("d53_sketch_merge")
def d53(t):
    parts = t.events.groupBy("event_type").agg(F.hll_sketch_agg("user_id", F.lit(12)).alias("sketch"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


@query(
    "d54_mergeable_statistics",
    """SELECT COUNT(*) AS n, round(AVG(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS var,
              MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem""",
)
def d54(t):
    """Statistics per part of the table, merged: M2 = sum of M2_i + sum of n_i (mean_i - mean)^2."""
    q = "l_quantity"
    parts = t.lineitem.groupBy("l_linenumber").agg(
        F.count(q).alias("n"), F.avg(q).alias("m"), (F.var_pop(q) * F.count(q)).alias("m2"),
        F.min(q).alias("low"), F.max(q).alias("high"),
    )
    n, c = F.sum("n"), F.col
    parts = attach_row(parts, parts.agg((F.sum(c("n") * c("m")) / n).alias("mean")))
    m2 = F.sum(c("m2") + c("n") * (c("m") - c("mean")) ** 2)
    return parts.agg(
        n.alias("n"), F.round(F.first("mean"), 6).alias("mean"), F.round(m2 / n, 6).alias("var"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


@query("d55_sum_approx")
def d55(t):
    return approx_sum(t.lineitem, "l_quantity", fraction=0.1, seed=4)


@query("d56_grouped_sum_approx")
def d56(t):
    return approx_sum(t.lineitem, "l_quantity", ["l_linestatus"], fraction=0.1, seed=4)


@query("d57_grouped_count_approx")
def d57(t):
    return approx_count(t.orders, ["o_orderstatus"], fraction=0.2, seed=5)


@query("d58_accumulable_collection")
def d58(t):
    return t.orders.agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))


@query(
    "d33_reduce_by_key_salted",
    f"SELECT l_returnflag, COUNT(*) AS n, {_msql('l_quantity')} AS q FROM lineitem GROUP BY 1",
)
def d33_salted(t):
    """Few keys: partial aggregation bounds a hot one, without a second shuffle."""
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), _money("l_quantity").alias("q"))
