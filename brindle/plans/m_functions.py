"""Functions reached by name; one query over a whole table for each."""

from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.registry import column_query, query, sql_query
from brindle.session import scratch_path

# --- aggregates --------------------------------------------------------------------------


@query("m1_collect_set", "SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS v FROM part GROUP BY 1")
def m1(t):
    return t.part.groupBy("p_type").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("v"))


@query("m2_context_ngrams")
def m2(t):
    return tx.context_ngrams(t.documents, "text", ["the", None], 20)


sql_query("m3_corr", "SELECT round(corr(l_quantity, l_extendedprice), 9) AS v FROM {lineitem}")
sql_query("m4_covar_pop", "SELECT l_returnflag, round(covar_pop(l_quantity, l_discount), 6) AS v FROM {lineitem} GROUP BY l_returnflag")
sql_query("m5_covar_samp", "SELECT l_returnflag, round(covar_samp(l_quantity, l_discount), 6) AS v FROM {lineitem} GROUP BY l_returnflag")


@query("m6_histogram_numeric")
def m6(t):
    return t.orders.agg(F.histogram_numeric("o_totalprice", F.lit(10)).alias("h")).select(F.inline("h"))


@query("m7_ngrams")
def m7(t):
    return tx.ngrams(t.documents, "text", 2, 50)


@query("m8_percentile_approx")
def m8(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 1000).alias("v"))


sql_query("m19_avg", "SELECT p_type, round(avg(p_retailprice), 6) AS v FROM {part} GROUP BY p_type")
sql_query("m39_count", "SELECT p_type, count(*) AS v, count(DISTINCT p_size) AS d FROM {part} GROUP BY p_type")
sql_query("m90_max", "SELECT p_type, max(p_name) AS v FROM {part} GROUP BY p_type")
sql_query("m91_min", "SELECT p_type, min(p_name) AS v FROM {part} GROUP BY p_type")
sql_query(
    "m103_percentile",
    "SELECT l_returnflag, percentile(l_quantity, 0.3) AS v FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, quantile_cont(l_quantity, 0.3) AS v FROM lineitem GROUP BY l_returnflag",
)
sql_query(
    "m132_std",
    "SELECT p_type, round(std(p_size), 6) AS v FROM {part} GROUP BY p_type",
    "SELECT p_type, round(stddev(p_size), 6) AS v FROM part GROUP BY p_type",
)
for _row, _fn in ((133, "stddev"), (134, "stddev_pop"), (135, "stddev_samp"), (159, "var_pop"), (160, "var_samp"), (161, "variance")):
    sql_query(f"m{_row}_{_fn}", f"SELECT p_type, round({_fn}(p_size), 6) AS v FROM {{part}} GROUP BY p_type")
sql_query("m141_sum", "SELECT p_type, CAST(sum(p_size) AS BIGINT) AS v FROM {part} GROUP BY p_type")

# --- math -----------------------------------------------------------------------------------

_x = "(p_size / 51)"  # inside (0, 1)


def _math(row, name, expr, oracle=None):
    column_query(f"m{row}_{name}", "part", "p_partkey", f"round({expr}, 9)", f"round({oracle or expr}, 9)")


_math(9, "e", "e() * p_size", "exp(1.0::DOUBLE) * p_size")
_math(10, "pi", "pi() * p_size")
column_query("m11_abs", "customer", "c_custkey", "abs(c_acctbal)")
_math(12, "acos", f"acos(cast({_x} as double))")
column_query("m13_add", "part", "p_partkey", "p_partkey + p_size")
_math(17, "asin", f"asin(cast({_x} as double))")
_math(18, "atan", "atan(cast(p_size as double))")
column_query("m22_bin", "orders", "o_orderkey", "bin(o_orderkey)")
column_query("m32_ceil", "customer", "c_custkey", "cast(ceil(c_acctbal) as bigint)")
column_query("m33_ceiling", "customer", "c_custkey", "cast(ceiling(c_acctbal) as bigint)")
column_query("m37_conv", "orders", "o_orderkey", "conv(o_orderkey, 10, 36)", "to_base(o_orderkey, 36)")
_math(38, "cos", "cos(cast(p_size as double))")
_math(45, "degrees", "degrees(cast(p_size as double))")
column_query("m46_div", "part", "p_partkey", "p_partkey div p_size", "p_partkey // p_size")
_math(47, "divide", "p_partkey / p_size")
_math(51, "exp", f"exp(cast({_x} as double))")
column_query("m56_floor", "customer", "c_custkey", "cast(floor(c_acctbal) as bigint)")
column_query("m63_hex", "orders", "o_orderkey", "hex(o_orderkey)")
_math(79, "ln", "ln(p_retailprice)")
_math(81, "log", "log(2, p_retailprice)", "log(2.0::DOUBLE, p_retailprice)")
_math(82, "log10", "log10(p_retailprice)")
_math(83, "log2", "log2(p_retailprice)")
column_query("m93_modulo", "orders", "o_orderkey", "(o_custkey - 700) % 9")
column_query("m96_negative", "customer", "c_custkey", "negative(c_acctbal)", "-c_acctbal")
column_query("m104_pmod", "orders", "o_orderkey", "pmod(o_custkey - 700, 9)", "((o_custkey - 700) % 9 + 9) % 9")
column_query("m105_positive", "customer", "c_custkey", "positive(c_acctbal)", "+c_acctbal")
_math(106, "pow", "pow(p_size, 3)")
_math(107, "power", "power(p_size, 0.5D)", "power(p_size, 0.5)")
_math(109, "radians", "radians(cast(p_size as double))")


@query("m110_rand")
def m110(t):
    return t.part.select("p_partkey", F.call_function("rand", F.lit(3)).alias("v"))


column_query("m119_round", "part", "p_partkey", "round(p_retailprice / 7, 3)")
column_query("m124_sign", "customer", "c_custkey", "cast(sign(c_acctbal) as int)", "cast(sign(c_acctbal) as integer)")
_math(125, "sin", "sin(cast(p_size as double))")
_math(131, "sqrt", "sqrt(p_retailprice)")
column_query("m140_subtract", "part", "p_partkey", "p_partkey - p_size")
_math(142, "tan", "tan(cast(p_size as double))")
column_query("m156_unhex", "part", "p_partkey", "cast(unhex(hex(p_name)) as string)", "decode(unhex(hex(p_name)))")


@query("m62_hash")
def m62(t):
    """Two hashes: the built-in one, and the value the old warehouse buckets by."""
    return t.part.select("p_partkey", F.hash("p_name").alias("h"), tx.bucket_hash(F.col("p_name")).alias("bucket_hash"))


# --- bits ----------------------------------------------------------------------------------

column_query("m26_bitwise_and", "orders", "o_orderkey", "o_orderkey & o_custkey")
column_query("m27_bitwise_not", "orders", "o_orderkey", "~o_custkey")
column_query("m28_bitwise_or", "orders", "o_orderkey", "o_orderkey | o_custkey")
column_query("m29_bitwise_xor", "orders", "o_orderkey", "o_orderkey ^ o_custkey", "xor(o_orderkey, o_custkey)")
_words2 = "array(o_orderkey, o_custkey)", "array(o_custkey, bigint(12))"
column_query(
    "m23_bitmap_and", "orders", "o_orderkey", f"array_join(transform(zip_with({_words2[0]}, {_words2[1]}, (x, y) -> x & y), v -> string(v)), ',')",
    "concat_ws(',', o_orderkey & o_custkey, o_custkey & 12)",
)
column_query(
    "m24_bitmap_empty", "orders", "o_orderkey", "forall(array(o_orderkey & 1, o_custkey & 2), x -> x = 0)", "(o_orderkey & 1) = 0 AND (o_custkey & 2) = 0"
)
column_query(
    "m25_bitmap_or", "orders", "o_orderkey", f"array_join(transform(zip_with({_words2[0]}, {_words2[1]}, (x, y) -> x | y), v -> string(v)), ',')",
    "concat_ws(',', o_orderkey | o_custkey, o_custkey | 12)",
)

# --- casts -----------------------------------------------------------------------------------

column_query("m21_bigint", "part", "p_partkey", "bigint(p_size) * 4000000000", "cast(p_size as bigint) * 4000000000")
column_query("m30_boolean", "part", "p_partkey", "boolean(p_size % 2)", "cast(p_size % 2 as boolean)")
column_query("m48_double", "part", "p_partkey", "double(p_size) / 4", "cast(p_size as double) / 4")
column_query("m55_float", "part", "p_partkey", "double(float(p_size))", "cast(cast(p_size as float) as double)")
column_query("m70_int", "part", "p_partkey", "int(floor(p_retailprice))", "cast(floor(p_retailprice) as integer)")
column_query("m127_smallint", "part", "p_partkey", "int(smallint(p_size))", "cast(cast(p_size as smallint) as integer)")
column_query("m136_string", "part", "p_partkey", "string(p_size)", "cast(p_size as varchar)")
column_query("m143_tinyint", "part", "p_partkey", "int(tinyint(p_size))", "cast(cast(p_size as tinyint) as integer)")
_bad = "if(p_size % 3 = 0, p_name, string(p_size))", "(case when p_size % 3 = 0 then p_name else cast(p_size as varchar) end)"
column_query(
    "m144_to_boolean", "part", "p_partkey", "coalesce(string(try_cast(if(p_size % 3 = 0, p_name, 'true') as boolean)), '-')",
    "case when p_size % 3 = 0 then '-' else 'true' end",
)
for _row, _name, _sp, _dk in (
    (145, "to_byte", "tinyint", "tinyint"), (147, "to_double", "double", "double"), (148, "to_float", "float", "float"),
    (149, "to_long", "bigint", "bigint"), (150, "to_short", "smallint", "smallint"),
):
    column_query(
        f"m{_row}_{_name}", "part", "p_partkey", f"double(coalesce(try_cast({_bad[0]} as {_sp}), {_sp}(-1)))",
        f"cast(coalesce(try_cast({_bad[1]} as {_dk}), -1) as double)",
    )
column_query("m151_to_string", "events", "event_id", "cast(user_id as string)", "cast(user_id as varchar)")

# --- conditions -----------------------------------------------------------------------------

column_query("m20_between", "part", "p_partkey", "p_size between 10 and 20")
column_query("m31_case", "part", "p_partkey", "case p_size when 1 then 'one' when 2 then 'two' else 'many' end")
column_query("m34_coalesce", "part", "p_partkey", "coalesce(nullif(p_size, 5), -1)")
column_query("m50_equal", "part", "p_partkey", "p_size = 7")
column_query("m60_greater_than", "part", "p_partkey", "p_size > 7")
column_query("m61_greater_or_equal", "part", "p_partkey", "p_size >= 7")
column_query("m65_if", "part", "p_partkey", "if(p_size > 25, 'big', 'small')", "case when p_size > 25 then 'big' else 'small' end")
column_query("m66_in", "part", "p_partkey", "p_size in (1, 2, 3)")
column_query("m71_isnotnull", "part", "p_partkey", "isnotnull(nullif(p_size, 5))", "nullif(p_size, 5) is not null")
column_query("m72_isnull", "part", "p_partkey", "isnull(nullif(p_size, 5))", "nullif(p_size, 5) is null")
column_query("m76_less_than", "part", "p_partkey", "p_size < 7")
column_query("m77_less_or_equal", "part", "p_partkey", "p_size <= 7")
column_query("m97_not", "part", "p_partkey", "not p_size > 7")
column_query("m98_not_equal", "part", "p_partkey", "p_size != 7")
column_query("m99_not_operator", "part", "p_partkey", "! (p_size > 7)", "not (p_size > 7)")
column_query("m100_nvl", "part", "p_partkey", "nvl(nullif(p_size, 5), 0)", "coalesce(nullif(p_size, 5), 0)")
column_query("m101_or", "part", "p_partkey", "p_size < 3 or p_size > 48")
column_query("m163_when", "part", "p_partkey", "case when p_size < 5 then 1 when p_size < 9 then 2 else 0 end")

# --- strings ------------------------------------------------------------------------------------

column_query("m16_ascii", "part", "p_partkey", "ascii(p_name)")
column_query("m35_concat", "part", "p_partkey", "concat(p_name, '/', p_brand)")
column_query("m36_concat_ws", "part", "p_partkey", "concat_ws('-', p_type, nullif(p_size, 5), p_brand)")
column_query("m49_elt", "part", "p_partkey", "elt(p_size % 2 + 1, p_name, p_brand)", "case p_size % 2 when 0 then p_name else p_brand end")


@query(
    "m53_field",
    "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'SMALL' THEN 3 ELSE 0 END AS v FROM part",
)
def m53(t):
    return t.part.select("p_partkey", tx.field(F.col("p_type"), F.lit("PROMO"), F.lit("LARGE"), F.lit("SMALL")).alias("v"))


column_query(
    "m54_find_in_set", "part", "p_partkey", "find_in_set(p_type, 'PROMO,LARGE,SMALL')",
    "case p_type when 'PROMO' then 1 when 'LARGE' then 2 when 'SMALL' then 3 else 0 end",
)
column_query("m57_format_number", "orders", "o_orderkey", "format_number(o_totalprice, 2)", "format('{:,.2f}', o_totalprice)")


@query("m67_in_file", "SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 50)")
def m67(t):
    path = scratch_path(t.spark, "in-file")
    t.part.filter("p_size = 50").select("p_name").write.text(path)
    return tx.in_file(t.part.select("p_partkey", "p_name"), "p_name", path)


column_query("m69_instr", "documents", "doc_id", "instr(text, 'th')", "cast(instr(text, 'th') as integer)")
column_query("m74_lcase", "part", "p_partkey", "lcase(p_type)")
column_query("m75_length", "documents", "doc_id", "length(text)", "cast(length(text) as integer)")
column_query("m78_like", "documents", "doc_id", "text like '%ion the%'")
column_query("m80_locate", "documents", "doc_id", "locate('e', text, 10)", "cast(case when instr(substring(text, 10), 'e') = 0 then 0 else instr(substring(text, 10), 'e') + 9 end as integer)")
column_query("m84_lower", "part", "p_partkey", "lower(p_brand)")
column_query("m85_lpad", "part", "p_partkey", "lpad(p_name, 12, '.')")
column_query("m86_ltrim", "part", "p_partkey", "ltrim(concat('  ', p_name, ' '))")
column_query("m102_parse_url", "pages", "page_id", "parse_url(url, 'HOST')", "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)")
column_query("m108_printf", "part", "p_partkey", "printf('%05d|%s', p_size, p_name)", "printf('%05d|%s', p_size, p_name)")
column_query("m113_regexp", "documents", "doc_id", "text regexp '[a-z]+tion'", "regexp_matches(text, '[a-z]+tion')")
column_query("m114_regexp_extract", "pages", "page_id", "regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2)")
column_query("m115_regexp_replace", "documents", "doc_id", "md5(regexp_replace(text, '[0-9]+', '#'))", "md5(regexp_replace(text, '[0-9]+', '#', 'g'))")
column_query("m116_repeat", "part", "p_partkey", "repeat(p_name, p_size % 3)")
column_query("m117_reverse", "part", "p_partkey", "reverse(p_name)")
column_query("m118_rlike", "pages", "page_id", "url rlike 'page=[0-9]'", "regexp_matches(url, 'page=[0-9]')")
column_query("m120_rpad", "part", "p_partkey", "rpad(p_name, 12, '.')")
column_query("m121_rtrim", "part", "p_partkey", "rtrim(concat(' ', p_name, '  '))")


@query("m123_sentences")
def m123(t):
    return t.documents.select("doc_id", F.size(F.sentences("text")).alias("n"))


column_query("m129_space", "part", "p_partkey", "concat(space(p_size), '|')", "repeat(' ', p_size) || '|'")
column_query("m130_split", "part", "p_partkey", "array_join(split(p_name, '[aeiou]'), '|')", "array_to_string(regexp_split_to_array(p_name, '[aeiou]'), '|')")
column_query("m138_substr", "part", "p_partkey", "substr(p_name, 2, 4)")
column_query("m139_substring", "part", "p_partkey", "substring(p_name, -3)")
column_query("m153_translate", "part", "p_partkey", "translate(p_name, 'aeiou', '12345')")
column_query("m154_trim", "part", "p_partkey", "trim(concat('  ', p_name, '  '))")
column_query("m155_ucase", "part", "p_partkey", "ucase(p_name)")
column_query("m158_upper", "part", "p_partkey", "upper(p_name)")

# --- dates ----------------------------------------------------------------------------------

_day = "%Y-%m-%d"
column_query("m40_date_add", "orders", "o_orderkey", "string(date_add(o_orderdate, 45))", f"strftime(o_orderdate + INTERVAL 45 DAY, '{_day}')")
column_query("m41_date_sub", "orders", "o_orderkey", "string(date_sub(o_orderdate, 45))", f"strftime(o_orderdate - INTERVAL 45 DAY, '{_day}')")
column_query("m42_datediff", "orders", "o_orderkey", "datediff(o_orderdate, date'1997-03-01')", "cast(date_diff('day', date '1997-03-01', cast(o_orderdate as date)) as integer)")
for _row, _fn in ((43, "day"), (44, "dayofmonth"), (94, "month"), (162, "weekofyear")):
    column_query(f"m{_row}_{_fn}", "orders", "o_orderkey", f"{_fn}(o_orderdate)", f"cast({_fn}(o_orderdate) as integer)")
for _row, _fn in ((64, "hour"), (92, "minute"), (122, "second")):
    column_query(f"m{_row}_{_fn}", "events", "event_id", f"{_fn}(ts)", f"cast({_fn}(ts) as integer)")
column_query("m58_from_unixtime", "orders", "o_orderkey", "from_unixtime(o_orderkey * 3601)", "strftime(make_timestamp(o_orderkey * 3601000000), '%Y-%m-%d %H:%M:%S')")
column_query("m146_to_date", "events", "event_id", "string(to_date(ts))", f"strftime(ts, '{_day}')")
column_query(
    "m152_to_unix_timestamp", "orders", "o_orderkey", "to_unix_timestamp(date_format(o_orderdate, 'dd/MM/yyyy'), 'dd/MM/yyyy')",
    "cast(epoch(o_orderdate) as bigint)",
)
column_query(
    "m157_unix_timestamp", "events", "event_id", "unix_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss'))", "cast(floor(epoch(ts)) as bigint)"
)

# --- arrays, maps, structs, JSON, XML, URLs ----------------------------------------------------

column_query("m14_array", "part", "p_partkey", "array(p_size, 7)[0] + array(p_size, 7)[1]", "p_size + 7")
column_query("m15_array_contains", "embeddings", "vec_id", "array_contains(array(label, 3), 5)", "label = 5")


@query("m52_explode", "SELECT p_type, COUNT(*) AS n FROM (SELECT p_type, unnest(range(0, p_size)) FROM part) x GROUP BY 1")
def m52(t):
    return t.part.select("p_type", F.explode(F.sequence(F.lit(1), "p_size"))).groupBy("p_type").agg(F.count("*").alias("n"))


column_query("m59_get_json_object", "events", "event_id", "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')")
sql_query(
    "m68_inline",
    "SELECT p_partkey, a, b FROM {part} LATERAL VIEW inline(array(named_struct('a', p_size, 'b', p_name), named_struct('a', 0, 'b', p_brand))) x",
    "SELECT p_partkey, p_size AS a, p_name AS b FROM part UNION ALL SELECT p_partkey, 0, p_brand FROM part",
)
column_query("m87_map", "part", "p_partkey", "map('a', p_size, 'b', 2)['a']", "p_size")
column_query("m88_map_keys", "part", "p_partkey", "array_join(sort_array(map_keys(map(p_name, 1, p_brand, 2))), ',')", "case when p_name < p_brand then p_name || ',' || p_brand else p_brand || ',' || p_name end")
column_query("m89_map_values", "part", "p_partkey", "aggregate(map_values(map('a', p_size, 'b', 2)), 0, (x, y) -> x + y)", "p_size + 2")
column_query("m95_named_struct", "part", "p_partkey", "named_struct('s', p_size, 'n', p_name).n", "p_name")
column_query("m126_size", "documents", "doc_id", "size(split(text, ' '))", "cast(len(string_split(text, ' ')) as integer)")
column_query("m128_sort_array", "part", "p_partkey", "array_join(sort_array(split(p_name, '')), '')", "array_to_string(list_sort(string_split(p_name, '')), '')")
column_query("m137_struct", "part", "p_partkey", "struct(p_size, p_name).p_size", "p_size")
sql_query(
    "m172_explode_table",
    "SELECT p_partkey, i FROM {part} LATERAL VIEW explode(array(p_size, p_size + 1)) x AS i",
    "SELECT p_partkey, p_size AS i FROM part UNION ALL SELECT p_partkey, p_size + 1 FROM part",
)
sql_query(
    "m173_json_tuple",
    "SELECT event_id, c0 AS k, coalesce(c1, '-') AS missing FROM {events} LATERAL VIEW json_tuple(props, 'k', 'none') x AS c0, c1",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, '-' AS missing FROM events",
)


@query(
    "m174_parse_url_tuple",
    """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS c0, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS c1,
       regexp_extract(url, '^([a-z]+):', 1) AS c2, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS c3 FROM pages""",
)
def m174(t):
    parts = tx.parse_url_tuple(F.col("url"), "HOST", "PATH", "PROTOCOL", "QUERY:page")
    return t.pages.select("page_id", *parts).fillna("", ["c3"])


sql_query(
    "m175_stack",
    "SELECT p_partkey, k, v FROM {part} LATERAL VIEW stack(2, 'type', p_type, 'brand', p_brand) x AS k, v",
    "SELECT p_partkey, 'type' AS k, p_type AS v FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part",
)
_xml = "concat('<a><b>', p_name, '</b><b>', p_brand, '</b><n>', p_size, '</n></a>')"
column_query("m164_xpath", "part", "p_partkey", f"array_join(xpath({_xml}, 'a/b/text()'), ',')", "p_name || ',' || p_brand")
column_query("m165_xpath_boolean", "part", "p_partkey", f"xpath_boolean({_xml}, 'a/n > 25')", "p_size > 25")
for _row, _fn, _cast in (
    (166, "double", "double"), (167, "float", "float"), (168, "int", "integer"), (169, "long", "bigint"), (170, "short", "smallint"),
):
    column_query(f"m{_row}_xpath_{_fn}", "part", "p_partkey", f"double(xpath_{_fn}({_xml}, 'sum(a/n)'))", f"cast(cast(p_size as {_cast}) as double)")
column_query("m171_xpath_string", "part", "p_partkey", f"xpath_string({_xml}, 'a/b')", "p_name")

# --- call-outs ---------------------------------------------------------------------------------

column_query("m73_java_method", "part", "p_partkey", "java_method('java.lang.Integer', 'toHexString', p_size)", "lower(to_hex(p_size))")
column_query("m111_reflect", "part", "p_partkey", "reflect('java.lang.String', 'valueOf', p_size)", "cast(p_size as varchar)")
column_query("m112_method_as_function", "part", "p_partkey", "startswith(p_name, 'red')", "starts_with(p_name, 'red')")
