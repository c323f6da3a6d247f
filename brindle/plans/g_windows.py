"""Sliding and cumulative functions over a whole ordered table."""

from pyspark.sql import functions as F

from brindle.operators.ordered import average_rank, running_totals, sliding
from brindle.registry import query


@query(
    "g1_sliding_window",
    """SELECT start, round(v0 + v1 + v2, 6) AS total FROM (SELECT row_number() OVER w - 1 AS start, value AS v0,
         lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2 FROM events WINDOW w AS (ORDER BY event_id)) x
       WHERE v2 IS NOT NULL""",
)
def g1(t):
    runs = sliding(t.events.select("event_id", "value"), [F.col("event_id")], 3, F.col("value"), "w", block_rows=1000)
    w = F.col("w")
    return runs.select("start", F.round(w[0] + w[1] + w[2], 6).alias("total"))


@query(
    "g2_area_under_curve",
    """SELECT round(SUM((x1 - x0) * (y0 + y1) / 2), 3) AS area FROM (SELECT p_partkey AS x0, p_retailprice AS y0,
         lead(p_partkey) OVER (ORDER BY p_partkey) AS x1, lead(p_retailprice) OVER (ORDER BY p_partkey) AS y1 FROM part) t""",
)
def g2(t):
    point = F.struct(F.col("p_partkey").alias("x"), F.col("p_retailprice").alias("y"))
    pairs = sliding(t.part.select("p_partkey", "p_retailprice"), [F.col("p_partkey")], 2, point, "w")
    a, b = F.col("w")[0], F.col("w")[1]
    return pairs.agg(F.round(F.sum((b["x"] - a["x"]) * (a["y"] + b["y"]) / 2), 3).alias("area"))


@query(
    "g3_cumulative_counts",
    """SELECT score, SUM(n) OVER (ORDER BY score DESC)::BIGINT AS upto FROM
       (SELECT floor(value)::BIGINT AS score, COUNT(*) AS n FROM events GROUP BY 1) x""",
)
def g3(t):
    counts = t.events.groupBy(F.floor("value").alias("score")).agg(F.count("*").alias("n"))
    return running_totals(counts, [], [F.desc("score")], {"upto": F.col("n")}).drop("n")


@query(
    "g4_average_rank",
    """SELECT p_partkey, rank() OVER (ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS r FROM part""",
)
def g4(t):
    return average_rank(t.part.select("p_partkey", "p_size"), "p_size", "r").drop("p_size")
