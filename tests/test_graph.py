"""Graph algorithms on stars, grids, chains, cycles and islands with known answers."""

import random

import pytest
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
from brindle.graph.frame import Graph, NotConverged, Send, place_edges, pregel
from brindle.graph.messages import message_passing
from brindle.graph.strong import strongly_connected_components


def graph(spark, pairs, extra=()):
    edges = spark.createDataFrame(list(pairs), "src long, dst long")
    g = Graph.from_edges(edges)
    if extra:
        g = Graph(g.vertices.unionAll(spark.createDataFrame([(x,) for x in extra], "id long")), edges)
    return g


def as_map(df):
    return {r[0]: r[1] for r in df.collect()}


def test_star_pagerank(spark):
    n = 30
    g = generators.star(spark.range(n))
    ranks = as_map(pagerank(g, 2))
    assert all(abs(ranks[i] - 0.15) < 1e-12 for i in range(1, n))
    assert abs(ranks[0] - (0.15 + 0.85 * 0.15 * (n - 1))) < 1e-9
    dynamic = as_map(pagerank_until(g, 1e-4))
    assert all(abs(ranks[i] - dynamic[i]) < 1e-6 for i in range(n))


def sequential_grid_rank(rows, cols, rounds):
    into = {i: [] for i in range(rows * cols)}
    out = dict.fromkeys(into, 0)
    for i in into:
        for j in ([i + 1] if i % cols < cols - 1 else []) + ([i + cols] if i + cols < rows * cols else []):
            into[j].append(i)
            out[i] += 1
    ranks = dict.fromkeys(into, 0.15)
    for _ in range(rounds):
        ranks = {i: 0.15 + 0.85 * sum(ranks[j] / out[j] for j in into[i]) for i in into}
    return ranks


def test_grid_pagerank(spark):
    g = generators.grid(spark.range(25), 5)
    want = sequential_grid_rank(5, 5, 10)
    got, dynamic = as_map(pagerank(g, 10)), as_map(pagerank_until(g, 1e-6))
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert all(abs(dynamic[i] - want[i]) < 1e-4 for i in want)


def test_components_of_grid_chain_and_islands(spark):
    assert set(as_map(connected_components(generators.grid(spark.range(16), 4))).values()) == {0}
    chain = graph(spark, [(i, i + 1) for i in range(9)] + [(i + 1, i) for i in range(20, 29)], extra=[99])
    parts = as_map(connected_components(chain))
    assert parts == {**{i: 0 for i in range(10)}, **{i: 20 for i in range(20, 30)}, 99: 99}


def test_components_of_a_hub(spark):
    hub = graph(spark, [(0, i) for i in range(1, 400)] + [(1000, 1001)])
    parts = as_map(connected_components(hub))
    assert {parts[i] for i in range(400)} == {0} and parts[1001] == 1000


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([], {7: 7, 8: 8}),
        ([(0, 1), (1, 2), (2, 0)], {0: 0, 1: 0, 2: 0}),
        ([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (6, 0), (5, 7)], {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}),
        ([(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 0)], {i: 0 for i in range(5)}),
    ],
)
def test_strong_components(spark, pairs, want):
    g = graph(spark, pairs, extra=[] if pairs else [7, 8])
    assert as_map(strongly_connected_components(g)) == want


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([(0, 1), (1, 2), (2, 0)], 1),
        ([(0, 1), (1, 2), (2, 0), (0, -1), (-1, -2), (-2, 0)], {0: 2}),
        ([(0, 1), (1, 2), (2, 0), (1, 0), (2, 1), (0, 2)], 1),
        ([(0, 1), (1, 2), (2, 0)] * 2, 1),
        ([(0, 1), (1, 2), (2, 3)], 0),
    ],
)
def test_triangles(spark, pairs, want):
    got = as_map(triangle_counts(graph(spark, pairs)))
    for i, n in got.items():
        assert n == (want.get(i, 1) if isinstance(want, dict) else want)


def test_label_propagation_of_cliques(spark):
    cliques = [(i, j) for base in (0, 10) for i in range(base, base + 5) for j in range(base, base + 5) if i != j]
    labels = as_map(label_propagation(graph(spark, cliques + [(0, 10)]), 10))
    assert len({labels[i] for i in range(5)}) == 1 and len({labels[i] for i in range(10, 15)}) == 1


def test_shortest_paths(spark):
    pairs = [(1, 2), (1, 5), (2, 3), (2, 5), (3, 4), (4, 5), (4, 6)]
    both = graph(spark, pairs + [(b, a) for a, b in pairs])
    got = {(r.id, r.landmark): r.hops for r in shortest_paths(both, [1, 4]).collect()}
    want = {1: (0, 2), 2: (1, 2), 3: (2, 1), 4: (2, 0), 5: (1, 1), 6: (3, 1)}
    assert got == {(i, lm): h for i, hs in want.items() for lm, h in zip((1, 4), hs)}


def test_transitive_closure(spark, rows):
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (3, 1)])
    want = sorted({(a, b) for a in (0, 1, 2, 3) for b in (1, 2, 3)})
    assert rows(transitive_closure(g.edges)) == want


def test_pregel_stops_without_messages(spark):
    g = graph(spark, [(i, i + 1) for i in range(6)])
    out = pregel(
        g, {"v": F.when(F.col("id") == 0, 0).otherwise(1000)},
        [Send("dst", {"m": F.col("src_v") + 1}, F.col("src_active") & (F.col("src_v") + 1 < F.col("dst_v")))],
        [F.min("m").alias("m")], {"v": F.least("v", "m")}, 50,
    )
    assert as_map(out) == {i: i for i in range(7)}


def test_attribute_operators(spark, rows):
    v = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 6), (1, 2, 7)], "src long, dst long, w int")
    g = Graph(v, e)
    assert rows(g.reverse().edges) == [(2, 1, 5), (2, 1, 7), (3, 2, 6)]
    assert rows(g.group_edges(F.sum("w").alias("w")).edges) == [(1, 2, 12), (2, 3, 6)]
    assert rows(g.triplets(), "src_name", "dst_name", "w") == [("a", "b", 5), ("a", "b", 7), ("b", "c", 6)]
    assert rows(g.subgraph(F.col("name") != "c").edges) == [(1, 2, 5), (1, 2, 7)]
    assert rows(g.subgraph(edge=F.col("w") > 5).edges) == [(1, 2, 7), (2, 3, 6)]
    assert rows(g.mask(Graph(v.filter("id < 3"), e.filter("w = 5"))).vertices) == [(1, "a"), (2, "b")]
    other = spark.createDataFrame([(1, None), (2, "z")], "id long, new string")
    assert sorted(map(str, rows(g.join_vertices(other, "name", F.col("new")).vertices.fillna("-"), "id", "name"))) == [
        "(1, '-')", "(2, 'z')", "(3, 'c')"]
    assert rows(g.degrees("either")) == [(1, 2), (2, 3), (3, 1)]
    assert rows(Graph.with_defaults(v.filter("id = 1"), e, {"name": F.lit("?")}).vertices) == [(1, "a"), (2, "?"), (3, "?")]


@pytest.mark.parametrize("rule", ["1d", "2d", "random", "canonical"])
def test_placement_keeps_equal_keys_together(spark, rule):
    e = spark.range(400).select((F.col("id") % 20).alias("src"), (F.col("id") * 7 % 31).alias("dst"))
    placed = place_edges(e, 9, rule).withColumn("p", F.spark_partition_id())
    assert placed.count() == 400
    if rule == "2d":
        assert placed.groupBy("src").agg(F.count_distinct("p").alias("n")).agg(F.max("n")).first()[0] <= 3
    if rule == "canonical":
        pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
        assert placed.groupBy(*pair).agg(F.count_distinct("p").alias("n")).agg(F.max("n")).first()[0] == 1


def test_svd_plus_plus_learns(spark):
    cells = [(u, 1000 + i, float((u * 3 + i * 5) % 5)) for u in range(20) for i in range(15) if (u + i) % 2]
    ratings = spark.createDataFrame(cells, "src long, dst long, rating double")
    first, mean = svd_plus_plus(ratings, 3, 1)
    later, _ = svd_plus_plus(ratings, 3, 8)
    assert abs(mean - sum(c[2] for c in cells) / len(cells)) < 1e-9
    assert later.agg(F.sum("error")).first()[0] < first.agg(F.sum("error")).first()[0]


def test_generators(spark):
    g = generators.log_normal(spark.range(200), 2.0, 0.5)
    assert g.edges.filter("dst < 0 OR dst >= 200").isEmpty()
    r = generators.r_mat(spark.range(500), 6)
    assert r.edges.agg(F.max(F.greatest("src", "dst"))).first()[0] < 64
    assert generators.grid(spark.range(12), 4).edges.count() == 3 * 3 + 2 * 4


def test_unfinished_rounds_are_an_error(spark):
    chain = Graph.from_edges(spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    for unfinished in (lambda: connected_components(chain, max_rounds=1), lambda: pagerank_until(chain, 1e-9, max_rounds=1)):
        with pytest.raises(NotConverged):
            unfinished()
    ring = Graph.from_edges(spark.range(6).select(F.col("id").alias("src"), ((F.col("id") + 1) % 3 + F.col("id") - F.col("id") % 3).alias("dst")))
    with pytest.raises(NotConverged):
        strongly_connected_components(ring, max_rounds=0)


def test_a_vertex_with_much_state_is_spread(spark):
    edges = spark.createDataFrame([(i, 1000) for i in range(60)] + [(1000, 2000 + i) for i in range(5)], "src long, dst long")
    closure = transitive_closure(edges)
    assert closure.count() == 65 + 60 * 5 and closure.filter("src < 60 and dst >= 2000").count() == 300


def test_messages_go_on_while_they_are_received(spark, rows):
    """Only the last vertex of the chain ever changes, yet each round's receivers send again."""
    g = graph(spark, [(i, i + 1) for i in range(5)])
    count = {"n": F.when(F.col("id") == 5, F.col("n") + F.col("m")).otherwise(F.col("n"))}
    send, merge = [Send("dst", {"m": F.lit(1)})], [F.sum("m").alias("m")]
    out = message_passing(g, {"n": F.lit(0)}, {"m": F.lit(0)}, send, merge, count, direction="out", ends=("src",))
    assert as_map(out) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}
    assert as_map(message_passing(g, {"n": F.lit(0)}, {"m": F.lit(0)}, send, merge, count, 3, "out"))[5] == 3


@pytest.mark.parametrize("direction, want", [("out", 4), ("in", 5), ("either", 5), ("both", 4)])
def test_direction_says_which_edges_carry_on(spark, direction, want):
    """After a first round that reaches all but 0, the edge 0 -> 1 is live by its target, not by its source."""
    g = graph(spark, [(i, i + 1) for i in range(3)])
    out = message_passing(
        g, {"n": F.lit(0)}, {"m": F.lit(0)}, [Send("dst", {"m": F.lit(1)})], [F.sum("m").alias("m")], {"n": F.col("n") + F.col("m")}, 2, direction)
    assert sum(as_map(out).values()) == {"out": 3 + 2, "in": 3 + 3, "either": 3 + 3, "both": 3 + 2}[direction] == want + 1


def test_the_first_message_goes_to_all(spark):
    """No edge sends: the state is what the initial message makes of it; no round at all gives the same."""
    star = graph(spark, [(0, i) for i in range(1, 6)])
    for rounds in (None, 0):
        out = message_passing(star, {"v": F.col("id")}, {"m": F.lit(10).cast("long")}, [Send("dst", {"m": F.col("src_v")}, F.lit(False))],
                              [F.max("m").alias("m")], {"v": F.col("v") + F.col("m")}, rounds)
        assert as_map(out) == {i: i + 10 for i in range(6)}
    with pytest.raises(ValueError):
        message_passing(star, {"v": F.col("id")}, {"v": F.lit(1)}, [], [], {})


def test_chain_propagation(spark):
    g = graph(spark, [(i, i + 1) for i in range(1, 9)])
    out = message_passing(
        g, {"v": (F.col("id") == 1).cast("int")}, {"m": F.lit(0)},
        [Send("dst", {"m": F.col("src_v")}, F.col("src_v") != F.col("dst_v"))], [F.max("m").alias("m")], {"v": F.greatest("v", "m")})
    assert set(as_map(out).values()) == {1}


def brute_strong(pairs):
    """Smallest id of each strong component, by reach from every vertex."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    reach = {}
    for v in out:
        seen, todo = {v}, [v]
        while todo:
            for w in out[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        reach[v] = seen
    return {v: min(w for w in reach[v] if v in reach[w]) for v in out}


@pytest.mark.parametrize("seed, n, edges", [(1, 12, 14), (2, 30, 40), (3, 40, 90), (4, 60, 66), (5, 25, 200)])
def test_strong_components_of_random_graphs(spark, seed, n, edges):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(edges)]
    assert as_map(strongly_connected_components(graph(spark, pairs))) == brute_strong(pairs)


def test_rings_tails_and_paths_between(spark):
    """A ring of twenty, a tail into it, a path out of a component and back, and a path that does not come back."""
    ring = [(i, (i + 1) % 20) for i in range(20)]
    tail = [(100 + i, 101 + i) for i in range(9)] + [(109, 3)]
    loop = [(200, 201), (201, 200), (200, 210), *[(210 + i, 211 + i) for i in range(12)], (222, 201)]
    lost = [(201, 300), *[(300 + i, 301 + i) for i in range(7)], (400, 304), (401, 400), (400, 401)]
    pairs = ring + tail + loop + lost
    assert as_map(strongly_connected_components(graph(spark, pairs))) == brute_strong(pairs)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Ten thousand vertices in a line, and five hundred in a ring; what is written is counted."""
    from brindle.graph import strong

    written = []
    keep = strong.cut_lineage
    monkeypatch.setattr(strong, "cut_lineage", lambda df: written.append(1) or keep(df))
    chain = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = strongly_connected_components(Graph.from_edges(chain))
    assert got.filter("id <> component").isEmpty() and got.count() == 10_001
    assert len(written) <= 40
    ring = spark.range(500).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(500)).alias("dst"))
    got = strongly_connected_components(Graph.from_edges(ring))
    assert got.filter("component <> 0").isEmpty() and got.count() == 500


def test_rounds_broadcast_neither_state_nor_an_empty_list_of_hot_ends(spark):
    """State would pass through the driver in every round; only a list of hot ends may, where there are any."""

    def plan(g):
        return g.prepared.triplets(g.vertices.withColumn("v", F.col("id") * 2), rounds=True)._jdf.queryExecution().optimizedPlan().toString()

    chain = graph(spark, [(i, i + 1) for i in range(50)])
    assert "strategy=broadcast" not in plan(chain) and plan(chain).count("strategy=merge") == 2
    star = Graph.from_edges(spark.range(1, 3000).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")))
    assert star.prepared.any_hot("dst") and not star.prepared.any_hot("src")
    found = star.prepared.triplets(star.vertices.withColumn("v", F.col("id") * 2), rounds=True)
    assert found.filter("src_v = 2 * src AND dst_v = 0").count() == 2999
