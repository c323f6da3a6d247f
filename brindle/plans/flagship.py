"""Headline star joins and aggregates; also what the bench times."""

from pyspark.sql import functions as F

from brindle.registry import query


@query(
    "flagship_revenue_by_nation",
    """SELECT n_name, CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue,
              COUNT(*) AS n_lines
       FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
            JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE r_name = 'ASIA' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""",
)
def revenue_by_nation(t):
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    nations = t.region.filter("r_name = 'ASIA'").join(t.nation, F.expr("n_regionkey = r_regionkey"))
    return (
        t.lineitem.join(t.orders, F.expr("l_orderkey = o_orderkey"))
        .join(t.customer, F.expr("o_custkey = c_custkey"))
        .join(nations, F.expr("c_nationkey = n_nationkey"))
        .groupBy("n_name")
        .agg(F.sum(revenue).cast("double").alias("revenue"), F.count("*").alias("n_lines"))
        .orderBy(F.desc("revenue"), "n_name")
        .limit(10)
    )


@query(
    "flagship_pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty,
              CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS sum_disc_price,
              COUNT(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY ALL""",
)
def pricing_summary(t):
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return (
        t.lineitem.filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
            F.sum(price).cast("double").alias("sum_disc_price"),
            F.count("*").alias("n"),
        )
    )
