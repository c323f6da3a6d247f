"""Graph operators and algorithms over graphs taken from the tables.

Call graph: distinct (user_id, k) of events as directed edges.  Trade graph:
customer (id 2 key) to supplier (id 2 key + 1) through orders and lines.
Chat graph: each turn of a conversation points at the next; a turn's id pairs
conversation c and turn t as (c + t)(c + t + 1) / 2 + t, which no other pair has.
"""

from pyspark.sql import functions as F

from brindle.graph import generators
from brindle.graph.algorithms import (
    connected_components,
    label_propagation,
    pagerank,
    pagerank_until,
    shortest_paths,
    svd_plus_plus,
    transitive_closure,
    triangle_counts,
)
from brindle.graph.frame import Graph, Send, place_edges, pregel
from brindle.graph.messages import message_passing
from brindle.graph.strong import strongly_connected_components
from brindle.operators.relational import attach_row, union_all_of
from brindle.registry import query

_CALLS = "(SELECT DISTINCT user_id AS src, CAST(json_extract(props, '$.k') AS BIGINT) AS dst FROM events)"
_IDS = f"(SELECT src AS id FROM {_CALLS} UNION SELECT dst FROM {_CALLS})"
_RAW = "(SELECT user_id AS src, CAST(json_extract(props, '$.k') AS BIGINT) AS dst, value FROM events)"


def _customer(key):
    return 2 * F.col(key)


def _supplier(key):
    return 2 * F.col(key) + 1


def _raw_calls(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select(F.col("user_id").alias("src"), k.alias("dst"), "value")


def _calls(t):
    return Graph.from_edges(_raw_calls(t).select("src", "dst").distinct())


def _trade(t):
    """Customers and suppliers with their balances; one edge per line."""
    lines = t.lineitem.join(t.orders, F.expr("l_orderkey = o_orderkey"))
    edges = lines.select(_customer("o_custkey").alias("src"), _supplier("l_suppkey").alias("dst"), F.col("l_quantity").alias("qty"))
    customers = t.customer.select(_customer("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    suppliers = t.supplier.select(_supplier("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return Graph(customers.unionAll(suppliers), edges)


_TRADE_E = "(SELECT 2 * o_custkey AS src, 2 * l_suppkey + 1 AS dst, l_quantity AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_TRADE_V = "(SELECT 2 * c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT 2 * s_suppkey + 1, s_acctbal FROM supplier)"


def _chat(t):
    def node(turn):
        both = F.col("conv_id") + turn
        return F.call_function("shiftright", both * (both + 1), F.lit(1)) + turn

    turns = t.conversations.select(node(F.col("turn")).alias("id"))
    return Graph(turns, t.conversations.filter("turn > 0").select(node(F.col("turn") - 1).alias("src"), node(F.col("turn")).alias("dst")))


N = "COUNT(*) AS n"


def _n():
    return F.count("*").alias("n")


# --- building and attributes -------------------------------------------------------------------


@query(
    "o1_graph_with_defaults",
    """SELECT id, coalesce(bal, -1.0) AS bal FROM (SELECT 2 * c_custkey AS id, c_acctbal AS bal FROM customer
        UNION ALL SELECT DISTINCT 2 * l_suppkey + 1, NULL FROM lineitem) x""",
)
def o1(t):
    g = _trade(t)
    customers = g.vertices.filter("id % 2 = 0")
    return Graph.with_defaults(customers, g.edges, {"bal": F.lit(-1.0)}).vertices


@query("o2_graph_from_edges", f"SELECT id FROM {_IDS}")
def o2(t):
    return _calls(t).vertices


@query("o3_graph_from_pairs", f"SELECT src, dst, {N} FROM {_RAW} GROUP BY 1, 2")
def o3(t):
    return Graph.from_pairs(_raw_calls(t), unique=True).edges


@query(
    "o4_triplets",
    f"SELECT src, dst, qty, a.bal AS src_bal, b.bal AS dst_bal FROM {_TRADE_E} JOIN {_TRADE_V} a ON src = a.id JOIN {_TRADE_V} b ON dst = b.id",
)
def o4(t):
    return _trade(t).triplets()


@query("o5_map_vertices", f"SELECT id, bal * 2 AS bal FROM {_TRADE_V}")
def o5(t):
    return _trade(t).map_vertices(bal=F.col("bal") * 2).vertices


@query("o6_map_edges", f"SELECT src, dst, qty + 1 AS qty FROM {_TRADE_E}")
def o6(t):
    return _trade(t).map_edges(qty=F.col("qty") + 1).edges


@query(
    "o7_map_triplets",
    f"SELECT src, dst, a.bal < b.bal AS poorer FROM {_TRADE_E} JOIN {_TRADE_V} a ON src = a.id JOIN {_TRADE_V} b ON dst = b.id",
)
def o7(t):
    return _trade(t).map_triplets(poorer=F.col("src_bal") < F.col("dst_bal")).edges.drop("qty")


@query("o8_reverse", f"SELECT dst AS src, src AS dst FROM {_CALLS}")
def o8(t):
    return _calls(t).reverse().edges


@query(
    "o9_subgraph",
    f"""SELECT src, dst, qty FROM {_TRADE_E} JOIN {_TRADE_V} a ON src = a.id JOIN {_TRADE_V} b ON dst = b.id
        WHERE a.bal > 0 AND b.bal > 0 AND a.bal > b.bal AND qty > 25""",
)
def o9(t):
    return _trade(t).subgraph(F.col("bal") > 0, (F.col("src_bal") > F.col("dst_bal")) & (F.col("qty") > 25)).edges


@query("o10_mask", f"SELECT src, dst, qty FROM {_TRADE_E} e WHERE EXISTS (SELECT 1 FROM {_TRADE_E} f WHERE f.src = e.src AND f.dst = e.dst AND f.qty = 50)")
def o10(t):
    g = _trade(t)
    return g.mask(Graph(g.vertices, g.edges.filter("qty = 50"))).edges


@query("o11_group_edges", f"SELECT src, dst, {N}, SUM(qty)::DOUBLE AS qty FROM {_TRADE_E} GROUP BY 1, 2")
def o11(t):
    return _trade(t).group_edges(_n(), F.sum("qty").alias("qty")).edges


@query(
    "o12_map_reduce_triplets",
    f"""SELECT id, COUNT(*) AS n, MAX(b) AS top FROM (SELECT dst AS id, a.bal AS b FROM {_TRADE_E} JOIN {_TRADE_V} a ON src = a.id WHERE a.bal > 0
        UNION ALL SELECT src, b.bal FROM {_TRADE_E} JOIN {_TRADE_V} b ON dst = b.id) x GROUP BY id""",
)
def o12(t):
    sends = [Send("dst", {"b": F.col("src_bal")}, F.col("src_bal") > 0), Send("src", {"b": F.col("dst_bal")})]
    return _trade(t).aggregate_messages(sends, [F.count("*").alias("n"), F.max("b").alias("top")])


_OUT = f"(SELECT src AS id, COUNT(*) AS degree FROM {_CALLS} GROUP BY 1)"


@query("o13_outer_join_vertices", f"SELECT id, coalesce(degree, 0) AS degree FROM {_IDS} LEFT JOIN {_OUT} USING (id)")
def o13(t):
    g = _calls(t)
    return g.outer_join_vertices(g.degrees("out")).vertices.fillna(0, ["degree"])


@query("o14_join_vertices", f"SELECT id, coalesce(degree * 1.0::DOUBLE, bal) AS bal FROM {_TRADE_V} LEFT JOIN (SELECT src AS id, COUNT(*) AS degree FROM {_TRADE_E} GROUP BY 1) USING (id)")
def o14(t):
    g = _trade(t)
    return g.join_vertices(g.degrees("out"), "bal", F.col("degree") * F.lit(1.0)).vertices


@query("o15_counts", f"SELECT (SELECT COUNT(*) FROM {_IDS}) AS vertices, (SELECT COUNT(*) FROM {_CALLS}) AS edges")
def o15(t):
    g = _calls(t)
    return attach_row(g.vertices.agg(F.count("*").alias("vertices")), g.edges.agg(F.count("*").alias("edges")))


@query(
    "o16_degrees",
    f"""SELECT 'in' AS kind, dst AS id, COUNT(*) AS degree FROM {_CALLS} GROUP BY 2 UNION ALL SELECT 'out', src, COUNT(*) FROM {_CALLS} GROUP BY 2
        UNION ALL SELECT 'all', id, COUNT(*) FROM (SELECT src AS id FROM {_CALLS} UNION ALL SELECT dst FROM {_CALLS}) x GROUP BY 2""",
)
def o16(t):
    g = _calls(t)
    kinds = [g.degrees(d).select(F.lit(k).alias("kind"), "id", "degree") for k, d in (("in", "in"), ("out", "out"), ("all", "either"))]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2])


def _csv(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@query("o17_collect_neighbor_ids", f"SELECT src AS id, 0 AS chunk, string_agg(dst, ',' ORDER BY dst) AS neighbors FROM {_CALLS} GROUP BY 1")
def o17(t):
    return _calls(t).neighbor_ids("out").withColumn("neighbors", _csv("neighbors"))


@query(
    "o18_collect_neighbors",
    f"""SELECT dst AS id, 0 AS chunk, string_agg(src || ':' || degree, ',' ORDER BY src) AS neighbors
        FROM {_CALLS} JOIN {_OUT} o ON src = o.id GROUP BY 1""",
)
def o18(t):
    g = _calls(t)
    near = Graph(g.degrees("out"), g.edges).neighbors("in")
    text = F.transform("neighbors", lambda s: F.concat_ws(":", s["id"].cast("string"), s["degree"].cast("string")))
    return near.select("id", "chunk", F.array_join(text, ",").alias("neighbors"))


@query("o19_collect_edges", f"SELECT dst AS id, 0 AS chunk, string_agg(src || '>' || dst, ',' ORDER BY src) AS edges FROM {_CALLS} GROUP BY 1")
def o19(t):
    text = F.transform("edges", lambda s: F.concat_ws(">", s["src"].cast("string"), s["dst"].cast("string")))
    return _calls(t).edge_lists("in").withColumn("edges", F.array_join(text, ","))


@query("o20_filter_after_preprocessing", f"SELECT src, dst FROM {_CALLS} JOIN {_OUT} a ON src = a.id JOIN {_OUT} b ON dst = b.id WHERE a.degree > 48 AND b.degree > 48")
def o20(t):
    g = _calls(t)
    return g.outer_join_vertices(g.degrees("out")).subgraph(F.col("degree") > 48).edges


@query("o21_pick_random_vertex")
def o21(t):
    return _calls(t).vertices.orderBy(F.rand(5)).limit(1)


# --- vertex and edge sets ------------------------------------------------------------------------


@query("o22_vertex_difference", "SELECT c_custkey AS id, v FROM (SELECT c_custkey, c_acctbal AS old, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS v FROM customer) x WHERE v <> old")
def o22(t):
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("old"))
    new = t.customer.select(F.col("c_custkey").alias("id"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("v"))
    return new.join(old, "id").filter(~F.col("v").eqNullSafe(F.col("old"))).drop("old")


@query("o23_vertex_inner_join", f"SELECT id, a.degree AS out_degree, b.degree AS in_degree FROM {_OUT} a JOIN (SELECT dst AS id, COUNT(*) AS degree FROM {_CALLS} GROUP BY 1) b USING (id)")
def o23(t):
    g = _calls(t)
    return g.degrees("out").withColumnRenamed("degree", "out_degree").join(g.degrees("in").withColumnRenamed("degree", "in_degree"), "id")


@query("o24_aggregate_using_index", f"SELECT dst AS id, MAX(value) AS top FROM {_RAW} WHERE dst IN (SELECT src FROM {_CALLS}) GROUP BY 1")
def o24(t):
    index = _calls(t).edges.select(F.col("src").alias("id")).distinct()
    return _raw_calls(t).groupBy(F.col("dst").alias("id")).agg(F.max("value").alias("top")).join(index, "id", "left_semi")


@query("o25_edge_inner_join", f"SELECT a.src, a.dst, n FROM {_CALLS} a JOIN (SELECT src, dst, {N} FROM {_RAW} GROUP BY 1, 2 HAVING COUNT(*) > 1) b ON a.src = b.src AND a.dst = b.dst")
def o25(t):
    counts = _raw_calls(t).groupBy("src", "dst").agg(_n()).filter("n > 1")
    return _calls(t).edges.join(counts, ["src", "dst"])


@query("o26_edge_placement")
def o26(t):
    edges = _calls(t).edges
    rules = ["1d", "2d", "random", "canonical"]
    placed = [place_edges(edges, 9, r).groupBy(F.spark_partition_id().alias("part")).agg(_n()).withColumn("rule", F.lit(r)) for r in rules]
    return union_all_of(placed)


# --- iterative --------------------------------------------------------------------------------


@query(
    "o27_pregel_max_value",
    f"""WITH v0 AS (SELECT id, id AS v FROM {_IDS}), s1 AS (SELECT dst AS id, MAX(v) AS m FROM {_CALLS} JOIN v0 ON src = id GROUP BY 1),
        v1 AS (SELECT id, greatest(v, coalesce(m, v)) AS v FROM v0 LEFT JOIN s1 USING (id)),
        s2 AS (SELECT dst AS id, MAX(v) AS m FROM {_CALLS} JOIN v1 ON src = id GROUP BY 1)
        SELECT id, greatest(v, coalesce(m, v)) AS v FROM v1 LEFT JOIN s2 USING (id)""",
)
def o27(t):
    """Two rounds of passing on the greatest id seen."""
    send, least = [Send("dst", {"m": F.col("src_v")})], {"m": F.lit(-1).cast("long")}
    return message_passing(_calls(t), {"v": F.col("id")}, least, send, [F.max("m").alias("m")], {"v": F.greatest("v", "m")}, 2, "out", ("src",))


def _pagerank_sql(rounds, edges=_CALLS, ids=_IDS):
    ctes = [f"w AS (SELECT src, dst, 1.0 / COUNT(*) OVER (PARTITION BY src) AS w FROM {edges})", f"r0 AS (SELECT id, 0.15::DOUBLE AS r FROM {ids})"]
    for i in range(1, rounds + 1):
        ctes.append(
            f"r{i} AS (SELECT id, 0.15 + 0.85 * coalesce(s, 0) AS r FROM r0 LEFT JOIN "
            f"(SELECT dst AS id, SUM(r * w) AS s FROM w JOIN r{i - 1} ON src = id GROUP BY 1) USING (id))"
        )
    return f"WITH {', '.join(ctes)} SELECT id, round(r, 8) AS rank FROM r{rounds}"


@query("o28_pagerank_fixed", _pagerank_sql(6))
def o28(t):
    return pagerank(_calls(t), 6).withColumn("rank", F.round("rank", 8))


@query("o29_pagerank_tolerance")
def o29(t):
    return pagerank_until(_calls(t), 0.001)


_NODE = "((conv_id + turn) * (conv_id + turn + 1) // 2 + turn)::BIGINT"
_CHAT = f"SELECT {_NODE} AS id, MIN({_NODE}) OVER (PARTITION BY conv_id) AS component FROM conversations"


@query("o30_connected_components", _CHAT)
def o30(t):
    return connected_components(_chat(t))


@query(
    "o31_strongly_connected_components",
    f"""WITH RECURSIVE reach AS (SELECT src, dst FROM {_CALLS} UNION SELECT r.src, e.dst FROM reach r JOIN {_CALLS} e ON r.dst = e.src)
        SELECT id, least(id, coalesce(MIN(b.dst), id)) AS component FROM {_IDS} LEFT JOIN reach a ON a.src = id
        LEFT JOIN reach b ON b.src = id AND b.dst = a.dst AND EXISTS (SELECT 1 FROM reach c WHERE c.src = a.dst AND c.dst = id) GROUP BY id""",
)
def o31(t):
    return strongly_connected_components(_calls(t))


@query(
    "o32_triangle_count",
    f"""WITH p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_CALLS} WHERE src <> dst),
        tri AS (SELECT x.a, x.b, y.b AS c FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b),
        c AS (SELECT id, COUNT(*) AS n FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) q GROUP BY 1)
        SELECT id, coalesce(n, 0) AS triangles FROM {_IDS} LEFT JOIN c USING (id)""",
)
def o32(t):
    return triangle_counts(_calls(t))


def _lpa_sql(rounds):
    ctes = [f"l0 AS (SELECT id, id AS l FROM {_IDS})"]
    for i in range(1, rounds + 1):
        ctes.append(
            f"l{i} AS (SELECT l0.id, coalesce(b.l, p.l) AS l FROM l0 JOIN l{i - 1} p USING (id) LEFT JOIN (SELECT id, l FROM "
            f"(SELECT id, l, COUNT(*) AS n FROM (SELECT dst AS id, l FROM {_CALLS} JOIN l{i - 1} ON src = id UNION ALL "
            f"SELECT src, l FROM {_CALLS} JOIN l{i - 1} ON dst = id) m GROUP BY 1, 2) "
            f"QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, l) = 1) b ON b.id = l0.id)"
        )
    return f"WITH {', '.join(ctes)} SELECT id, l AS label FROM l{rounds}"


@query("o33_label_propagation", _lpa_sql(3))
def o33(t):
    return label_propagation(_calls(t), 3)


@query(
    "o34_shortest_paths",
    f"""WITH RECURSIVE p AS (SELECT id, id AS landmark, 0 AS hops FROM {_IDS} WHERE id IN (3, 42)
        UNION SELECT e.src, p.landmark, p.hops + 1 FROM p JOIN {_CALLS} e ON e.dst = p.id WHERE p.hops < 8)
        SELECT id, landmark, MIN(hops)::INTEGER AS hops FROM p GROUP BY 1, 2""",
)
def o34(t):
    return shortest_paths(_calls(t), [3, 42])


@query("o35_svd_plus_plus")
def o35(t):
    """Users rate values k by the mean of their events, on a scale of 0 to 5."""
    k = 2 * F.get_json_object("props", "$.k").cast("long") + 1
    rows = t.events.select((2 * F.col("user_id")).alias("src"), k.alias("dst"), F.least(F.col("value") / 50, F.lit(5.0)).alias("rating"))
    ratings = rows.groupBy("src", "dst").agg(F.avg("rating").alias("rating"))
    return svd_plus_plus(ratings, rank=4, rounds=2)[0].select("id", "p", "y", "bias", "norm", "error")


# --- generators ----------------------------------------------------------------------------------


def _ids(t):
    return t.customer.select(F.col("c_custkey").alias("id"))


@query("o36_log_normal_generator")
def o36(t):
    g = generators.log_normal(_ids(t), mu=1.5, sigma=0.8)
    return g.degrees("out")


@query("o37_r_mat_generator")
def o37(t):
    return generators.r_mat(t.orders.select(F.col("o_orderkey").alias("id")), 10).degrees("out")


@query(
    "o38_grid_generator",
    """SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer WHERE c_custkey % 40 < 39 AND c_custkey + 1 < (SELECT COUNT(*) FROM customer)
       UNION ALL SELECT c_custkey, c_custkey + 40 FROM customer WHERE c_custkey + 40 < (SELECT COUNT(*) FROM customer)""",
)
def o38(t):
    return generators.grid(_ids(t), 40).edges


@query("o39_star_generator", "SELECT c_custkey AS src, 0::BIGINT AS dst FROM customer WHERE c_custkey <> 0")
def o39(t):
    return generators.star(_ids(t)).edges


# --- jobs -----------------------------------------------------------------------------------------


@query(
    "o40_pregel_with_aggregator",
    f"""WITH v0 AS (SELECT id, 1 AS v FROM {_IDS}), t0 AS (SELECT SUM(v) AS total FROM v0),
        s1 AS (SELECT dst AS id, SUM(v) AS m FROM {_CALLS} JOIN v0 ON src = id GROUP BY 1)
        SELECT id, CASE WHEN m IS NULL THEN v ELSE m * total END::BIGINT AS v FROM v0 LEFT JOIN s1 USING (id) CROSS JOIN t0""",
)
def o40(t):
    """One round in which the global sum of the state reaches every update."""
    return pregel(
        _calls(t), {"v": F.lit(1).cast("long")}, [Send("dst", {"m": F.col("src_v")})], [F.sum("m").alias("m")],
        {"v": F.col("m") * F.col("total")}, 1, ends=("src",), aggregator=F.sum("v"),
    )


@query(
    "o41_transitive_closure",
    f"""WITH RECURSIVE reach AS (SELECT src, dst FROM {_CALLS} UNION SELECT r.src, e.dst FROM reach r JOIN {_CALLS} e ON r.dst = e.src)
        SELECT src, dst FROM reach""",
)
def o41(t):
    return transitive_closure(_calls(t).edges)


@query("o42_pagerank_of_links", _pagerank_sql(3))
def o42(t):
    """Ranks from link text: lines of ``source target``, read back as an edge list."""
    from brindle.session import scratch_path
    from brindle.sources.text import read_edge_list

    path = scratch_path(t.spark, "links")
    _raw_calls(t).select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)
    links = read_edge_list(t.spark, path).distinct()
    return pagerank(Graph.from_edges(links), 3).withColumn("rank", F.round("rank", 8))


@query("o43_vertex_filter_map", f"SELECT id, bal + 1 AS bal FROM {_TRADE_V} WHERE bal > 500")
def o43(t):
    return _trade(t).vertices.filter("bal > 500").withColumn("bal", F.col("bal") + 1)


@query("o44_vertex_left_join", f"SELECT id, coalesce(degree, -1) AS degree FROM {_IDS} LEFT JOIN (SELECT dst AS id, COUNT(*) AS degree FROM {_CALLS} GROUP BY 1) USING (id)")
def o44(t):
    g = _calls(t)
    return g.vertices.join(g.degrees("in"), "id", "left").fillna(-1, ["degree"])


@query("o45_edge_map_filter_reverse", f"SELECT dst AS src, src AS dst, qty * 2 AS qty FROM {_TRADE_E} WHERE qty > 45")
def o45(t):
    return Graph(_trade(t).vertices, _trade(t).edges.filter("qty > 45")).map_edges(qty=F.col("qty") * 2).reverse().edges


@query(
    "o46_other_end_of_triplet",
    f"""SELECT id, COUNT(*) AS n, MAX(seen) AS seen FROM (SELECT src AS id, b.bal AS seen FROM {_TRADE_E} JOIN {_TRADE_V} b ON dst = b.id
        UNION ALL SELECT dst, a.bal FROM {_TRADE_E} JOIN {_TRADE_V} a ON src = a.id) x GROUP BY id""",
)
def o46(t):
    """Each vertex looks along its edges at the attribute of the other end."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst_bal").alias("seen")), F.struct(F.col("dst").alias("id"), F.col("src_bal").alias("seen")))
    return _trade(t).triplets().select(F.inline(ends)).groupBy("id").agg(_n(), F.max("seen").alias("seen"))


@query(
    "o47_edge_direction",
    f"""SELECT 'both' AS direction, COUNT(*) AS n FROM {_CALLS} a JOIN {_CALLS} b ON a.src = b.dst AND a.dst = b.src
        UNION ALL SELECT 'either', 2 * COUNT(*) FROM {_CALLS} UNION ALL SELECT 'in', COUNT(*) FROM {_CALLS} UNION ALL SELECT 'out', COUNT(*) FROM {_CALLS}""",
)
def o47(t):
    g = _calls(t)
    return union_all_of([g.directed_pairs(d).agg(F.lit(d).alias("direction"), _n()) for d in ("both", "either", "in", "out")])


@query("o48_graph_job", f"WITH c AS ({_CHAT}) SELECT component, {N} FROM c GROUP BY 1")
def o48(t):
    """Components of an edge list on disk, counted."""
    from brindle.session import scratch_path
    from brindle.sources.text import read_edge_list

    chat, path = _chat(t), scratch_path(t.spark, "chat")
    chat.edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)
    found = connected_components(Graph(chat.vertices, read_edge_list(t.spark, path)))
    return found.groupBy("component").agg(_n())


@query("o49_web_page_rank")
def o49(t):
    """Links between pages: a page is named by the first word of its title, and an href to that word leads to the first page of the name."""
    word = F.lower(F.regexp_extract("html", r"<title>([^ <]+)", 1))
    named = t.pages.groupBy(word.alias("word")).agg(F.min("page_id").alias("dst")).filter("word <> ''")
    hrefs = t.pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"]+)"'), 1)).alias("href"))
    links = hrefs.select("src", F.lower("href").alias("word")).distinct().join(named, "word").select("src", "dst").distinct()
    return pagerank(Graph(t.pages.select(F.col("page_id").alias("id")), links), 3)
