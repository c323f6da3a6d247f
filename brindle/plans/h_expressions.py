"""Scalar expressions."""

from pyspark.sql import functions as F

from brindle.functions import casts
from brindle.registry import column_query, query, sql_query

column_query("h1_add", "lineitem", "l_orderkey, l_linenumber", "l_partkey + l_suppkey")


@query(
    "h1_add_wraps",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey = 0 THEN 9223372036854775807
              ELSE CAST(o_orderkey - 1 AS HUGEINT) - 9223372036854775808 END AS BIGINT) AS v FROM orders""",
)
def h1_wraps(t):
    return t.orders.select("o_orderkey", casts.wrapping_add(F.col("o_orderkey"), F.lit((1 << 63) - 1)).alias("v"))


@query("h1_try_add", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey = 0 THEN 9223372036854775807 END, -1) AS v FROM orders")
def h1_try(t):
    return t.orders.select("o_orderkey", F.coalesce(F.try_add("o_orderkey", F.lit((1 << 63) - 1)), F.lit(-1)).alias("v"))


column_query("h2_subtract", "orders", "o_orderkey", "o_custkey - o_orderkey")
column_query("h3_multiply", "lineitem", "l_orderkey, l_linenumber", "round(l_quantity * l_discount, 6)")
column_query("h4_divide_fractional", "part", "p_partkey", "round(p_size / 7, 9)")


@query(
    "h5_divide_by_zero",
    "SELECT p_partkey, coalesce(round(p_partkey / nullif(p_size % 4, 0), 9), -1) AS v FROM part",
)
def h5(t):
    ratio = casts.safe_divide(F.col("p_partkey"), F.col("p_size") % 4)
    return t.part.select("p_partkey", F.coalesce(F.round(ratio, 9), F.lit(-1.0)).alias("v"))


column_query("h6_integer_division", "orders", "o_orderkey", "o_orderkey div 7", "o_orderkey // 7")
column_query("h7_remainder", "orders", "o_orderkey", "(o_orderkey - 500) % 7")
column_query("h8_unary_minus", "customer", "c_custkey", "-c_acctbal")
column_query("h9_if", "customer", "c_custkey", "if(c_acctbal < 0, 'debt', 'credit')", "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END")
column_query(
    "h10_case_when", "part", "p_partkey", "CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END"
)
column_query("h10_case_key", "orders", "o_orderkey", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END")
column_query(
    "h11_case_type_unification",
    "part",
    "p_partkey",
    "CAST(CASE WHEN p_size < 25 THEN p_size ELSE p_retailprice END AS DOUBLE)",
)
column_query("h12_coalesce", "part", "p_partkey", "coalesce(nullif(p_size % 3, 0), nullif(p_size % 5, 0), -7)")
column_query("h13_upper", "part", "p_partkey", "upper(p_name)")
column_query("h14_lower", "customer", "c_custkey", "lower(c_mktsegment)")
column_query("h15_substring", "customer", "c_custkey", "substring(c_name, 4, 9)")
column_query("h15_substring_zero", "customer", "c_custkey", "substring(c_name, 0, 5)", "substring(c_name, 1, 5)")
column_query("h15_substring_negative", "customer", "c_custkey", "substring(c_name, -6, 4)")
column_query("h15_substring_binary", "part", "p_partkey", "hex(substring(cast(p_name as binary), 2, 3))", "upper(hex(substring(p_name, 2, 3)))")
column_query("h16_like", "part", "p_partkey", "p_name LIKE '%e_ %t'")
column_query("h16_like_escape", "pages", "page_id", r"url LIKE '%\\_%' OR url LIKE '%page=_%'", "url LIKE '%!_%' ESCAPE '!' OR url LIKE '%page=_%'")
column_query("h17_rlike", "documents", "doc_id", "text rlike '[0-9]{3}'", "regexp_matches(text, '[0-9]{3}')")
column_query("h18_contains", "documents", "doc_id", "contains(text, 'the')")
column_query("h19_starts_with", "pages", "page_id", "startswith(url, 'https://')", "starts_with(url, 'https://')")
column_query("h20_ends_with", "pages", "page_id", "endswith(url, '#top')", "ends_with(url, '#top')")
column_query(
    "h21_cast_bad_input_null",
    "customer",
    "c_custkey",
    "coalesce(try_cast(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE cast(c_custkey AS string) END AS int), -1)",
    "coalesce(try_cast(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE cast(c_custkey AS varchar) END AS integer), -1)",
)


@query(
    "h22_cast_to_string",
    """SELECT event_id, regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '') AS v,
              CAST(user_id AS VARCHAR) AS u FROM events""",
)
def h22(t):
    return t.events.select("event_id", casts.trimmed_timestamp_text(F.col("ts")).alias("v"), F.col("user_id").cast("string").alias("u"))


@query(
    "h23_cast_to_boolean",
    "SELECT p_partkey, p_size % 5 <> 0 AS n, length(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END) > 0 AS s FROM part",
)
def h23(t):
    text = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name"))
    return t.part.select(
        "p_partkey", casts.number_to_boolean(F.col("p_size") % 5).alias("n"), casts.string_to_boolean(text).alias("s")
    )


@query(
    "h24_cast_to_timestamp",
    """SELECT o_orderkey, strftime(make_timestamp(o_custkey * 86400 * 1000000), '%Y-%m-%d %H:%M:%S') AS v,
              (o_orderkey % 2 = 0) AS parsed FROM orders""",
)
def h24(t):
    seconds = F.col("o_custkey") * 86400
    text = F.when(F.col("o_orderkey") % 2 == 0, F.lit("2001-02-03 04:05:06")).otherwise(F.lit("no date"))
    return t.orders.select(
        "o_orderkey",
        F.date_format(casts.number_to_timestamp(seconds), "yyyy-MM-dd HH:mm:ss").alias("v"),
        F.try_to_timestamp(text).isNotNull().alias("parsed"),
    )


column_query("h25_cast_to_decimal", "orders", "o_orderkey", "cast(cast(o_totalprice AS decimal(20, 2)) AS string)", "cast(cast(o_totalprice AS decimal(20, 2)) AS varchar)")
column_query("h26_cast_to_binary", "part", "p_partkey", "hex(cast(p_name AS binary))", "hex(p_name)")


@query(
    "h27_nan_literal",
    "SELECT c_custkey, isnan(x) AS v FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS x FROM customer) y",
)
def h27(t):
    x = F.when(F.col("c_custkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return t.customer.select("c_custkey", (x == F.lit("NaN").try_cast("double")).alias("v"))


column_query(
    "h28_string_promoted_in_comparison",
    "customer",
    "c_custkey",
    "coalesce(try_cast(substring(c_name, 10) AS double) > 700, false)",
    "coalesce(try_cast(substring(c_name, 10) AS double) > 700, false)",
)
column_query("h29_boolean_compared_with_number", "part", "p_partkey", "cast(p_size > 25 AS int) = p_size % 2", "cast(p_size > 25 AS integer) = p_size % 2")


@query(
    "h30_element_access",
    """SELECT vec_id, embedding[1] AS first, coalesce(embedding[65], 7) AS outside, label AS m,
              coalesce(CASE WHEN label = 3 THEN 'three' END, '-') AS missing FROM embeddings""",
)
def h30(t):
    names = F.create_map(F.lit(3), F.lit("three"))
    return t.embeddings.select(
        "vec_id",
        F.get("embedding", F.lit(0)).alias("first"),
        F.coalesce(F.get("embedding", F.lit(64)), F.lit(7).cast("float")).alias("outside"),
        F.try_element_at(F.create_map(F.lit("l"), F.col("label")), F.lit("l")).alias("m"),
        F.coalesce(F.try_element_at(names, F.col("label")), F.lit("-")).alias("missing"),
    )


@query(
    "h31_struct_field",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id AS u, event_type || ',' || 'x' AS names FROM events",
)
def h31(t):
    s = F.struct(F.from_json("props", "k int").alias("p"), F.struct("user_id").alias("who"))
    arr = F.array(F.struct(F.col("event_type").alias("name")), F.struct(F.lit("x").alias("name")))
    rows = t.events.select("event_id", s.alias("s"), arr.alias("arr"))
    return rows.select(
        "event_id", F.col("s.p.k").alias("k"), F.col("s.who.user_id").alias("u"), F.array_join(F.col("arr.name"), ",").alias("names")
    )


sql_query(
    "h32_literals",
    """SELECT s_suppkey, 7 AS i, 3000000000 AS l, CAST(2.5 AS DOUBLE) AS d, 'x' AS s, true AS b, NULL IS NULL AS n
       FROM {supplier}""",
)
column_query(
    "h33_cast_to_integrals",
    "orders",
    "o_orderkey",
    "concat_ws(',', cast(o_totalprice AS bigint), cast(floor(o_totalprice) AS int), try_cast(o_custkey AS smallint), coalesce(try_cast(o_custkey AS tinyint), -1))",
    "concat_ws(',', cast(trunc(o_totalprice) AS bigint), cast(floor(o_totalprice) AS integer), try_cast(o_custkey AS smallint), coalesce(try_cast(o_custkey AS tinyint), -1))",
)
column_query("h34_cast_to_double_float", "part", "p_partkey", "cast(cast(p_size AS float) AS double) + cast('0.5' AS double)")
column_query("h35_adjacent_literals", "supplier", "s_suppkey", "concat('sup', 'pl', 'ier ', s_name)")
