"""Generators and lateral views."""

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from brindle.registry import query

_WORDS = "(SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)"


@query("i1_explode_array", f"SELECT w, COUNT(*) AS n FROM {_WORDS} x GROUP BY w")
def i1(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query(
    "i1_explode_map",
    "SELECT p_partkey, 'size' AS k, p_size AS v FROM part UNION ALL SELECT p_partkey, 'len', length(p_name)::INTEGER FROM part",
)
def i1_map(t):
    m = F.create_map(F.lit("size"), F.col("p_size"), F.lit("len"), F.length("p_name"))
    return t.part.select("p_partkey", F.explode(m).alias("k", "v"))


@query(
    "i2_generate_outer",
    """SELECT p_partkey, p_size, unnest(range(1, p_size % 3 + 1))::INTEGER AS i FROM part WHERE p_size % 3 > 0
       UNION ALL SELECT p_partkey, p_size, -1 FROM part WHERE p_size % 3 = 0""",
)
def i2(t):
    items = F.when(F.col("p_size") % 3 > 0, F.sequence(F.lit(1), F.col("p_size") % 3))
    return t.part.select("p_partkey", "p_size", F.explode_outer(items).alias("i")).fillna(-1, ["i"])


@query(
    "i3_lateral_view",
    """SELECT p_partkey, w, c FROM (SELECT p_partkey, w, unnest(string_split(w, 'e')) AS c FROM
       (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) x) y""",
)
def i3(t):
    return t.sql(
        """SELECT p_partkey, w, c FROM {part} LATERAL VIEW explode(split(p_name, ' ')) words AS w
           LATERAL VIEW OUTER explode(split(w, 'e')) pieces AS c"""
    )


@query("i4_generator_in_select", "SELECT doc_id, unnest(string_split(source, 'c')) AS piece FROM documents")
def i4(t):
    return t.documents.select("doc_id", F.explode(F.split("source", "c")).alias("piece"))


@udtf(returnType="square: bigint, cube: bigint")
class Powers:
    """Two powers of each number up to n."""

    def eval(self, n: int):
        for i in range(1, n + 1):
            yield i * i, i * i * i


@query(
    "i5_custom_row_generator",
    "SELECT p_partkey, i * i AS square, i * i * i AS cube FROM (SELECT p_partkey, unnest(range(1, p_size % 4 + 1)) AS i FROM part) x",
)
def i5(t):
    return t.part.select("p_partkey", "p_size").lateralJoin(Powers((F.col("p_size") % 4).outer())).select("p_partkey", "square", "cube")


@query(
    "i6_generator_by_name",
    "SELECT l_returnflag, pos, COUNT(*) AS n FROM (SELECT l_returnflag, unnest(range(0, l_linenumber))::INTEGER AS pos FROM lineitem) x GROUP BY ALL",
)
def i6(t):
    rows = t.lineitem.select("l_returnflag", F.call_function("posexplode", F.sequence(F.lit(1), F.col("l_linenumber"))))
    return rows.groupBy("l_returnflag", "pos").agg(F.count("*").alias("n"))
