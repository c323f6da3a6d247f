"""User functions: scalar, struct-valued, row predicates, aggregates."""

import pandas as pd
from pyspark.sql import functions as F

from brindle.registry import query


@query("j1_register_scalar_function", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def j1(t):
    @F.pandas_udf("int")
    def twice_plus_one(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    t.spark.udf.register("twice_plus_one", twice_plus_one)
    return t.sql("SELECT p_partkey, twice_plus_one(p_size) AS v FROM {part}")


@query("j2_register_python_function", "SELECT c_custkey, length(c_name) + c_nationkey AS v FROM customer")
def j2(t):
    t.spark.udf.register("name_score", lambda name, nation: len(name) + nation, "long")
    return t.sql("SELECT c_custkey, name_score(c_name, c_nationkey) AS v FROM {customer}")


@query("j3_jvm_function", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS v FROM part")
def j3(t):
    """A static JVM method by class name; ``spark.udf.registerJavaFunction`` takes a user's own class."""
    return t.part.select("p_partkey", F.java_method(F.lit("java.lang.String"), F.lit("valueOf"), F.col("p_size")).alias("v"))


@query("j4_scalar_function_over_columns", "SELECT l_orderkey, l_linenumber, round(l_quantity * (1 + l_tax), 6) AS v FROM lineitem")
def j4(t):
    @F.pandas_udf("double")
    def with_tax(q: pd.Series, tax: pd.Series) -> pd.Series:
        return (q * (1 + tax)).round(6)

    return t.lineitem.select("l_orderkey", "l_linenumber", with_tax("l_quantity", "l_tax").alias("v"))


@query("j5_python_batches", "SELECT event_id, reverse(event_type) AS v FROM events")
def j5(t):
    @F.pandas_udf("string")
    def backwards(s: pd.Series) -> pd.Series:
        return s.str[::-1]

    return t.events.select("event_id", backwards("event_type").alias("v"))


@query("j6_struct_result", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, length(p_name) AS n FROM part")
def j6(t):
    @F.pandas_udf("first string, n long")
    def parts(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"first": s.str.split(" ").str[0], "n": s.str.len()})

    return t.part.select("p_partkey", parts("p_name").alias("r")).select("p_partkey", "r.first", "r.n")


@query("j7_row_predicate", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 100 * s_nationkey")
def j7(t):
    def keep(batches):
        for rows in batches:
            yield rows.loc[rows.s_acctbal > 100 * rows.s_nationkey, ["s_suppkey", "s_name"]]

    rows = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return rows.mapInPandas(keep, "s_suppkey long, s_name string")


@query("j8_simple_function_by_name", "SELECT p_partkey, ascii(p_name) AS v FROM part")
def j8(t):
    return t.part.select("p_partkey", F.call_function("ascii", F.col("p_name")).alias("v"))


@query("j9_generic_function_by_name", "SELECT p_partkey, greatest(p_size, p_partkey) AS v FROM part")
def j9(t):
    return t.part.select("p_partkey", F.call_function("greatest", F.col("p_size"), F.col("p_partkey")).alias("v"))


@query(
    "j10_user_aggregate",
    "SELECT l_returnflag, COUNT(*) AS n, round(ln_sum / COUNT(*), 6) AS mean_log FROM lineitem JOIN (SELECT l_returnflag, SUM(ln(l_quantity)) AS ln_sum FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY l_returnflag, ln_sum",
)
def j10(t):
    """A user aggregate (mean logarithm) as mergeable partials: no group is gathered in one task."""
    from brindle.operators.grouping import fold_by_key

    def merge(rows):
        return rows.groupby("l_returnflag", as_index=False)[["n", "s"]].sum()

    rows = t.lineitem.select("l_returnflag", F.lit(1).cast("long").alias("n"), F.log("l_quantity").alias("s"))
    sums = fold_by_key(rows, ["l_returnflag"], merge, "l_returnflag string, n long, s double")
    return sums.select("l_returnflag", "n", F.round(F.col("s") / F.col("n"), 6).alias("mean_log"))
