"""Graph algorithms as rounds of joins and grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.graph.frame import Graph, NotConverged, Send, collect_messages, pregel
from brindle.operators.relational import add_salt, hot_from_counts, repeat_per_salt, salted_join, union_all_of
from brindle.session import cut_lineage


def _out_weighted(graph: Graph) -> Graph:
    """Edges with weight 1 / out-degree of the source."""
    edges = cut_lineage(graph.edges.select("src", "dst"))
    degrees = edges.groupBy("src").agg(F.count("*").alias("degree"))
    hot = hot_from_counts(degrees.select("src", F.col("degree").alias("__n")), ["src"])
    weighted = salted_join(edges, degrees, ["src"], hot=hot)
    edges = weighted.select("src", "dst", (1.0 / F.col("degree")).alias("weight"))
    return Graph(cut_lineage(graph.vertices.select("id")), edges)


def pagerank(graph: Graph, rounds: int, reset: float = 0.15, cut_every: int = 4) -> DataFrame:
    """Unnormalised rank after fixed rounds: reset + (1 - reset) * sum of incoming shares.

    All vertices start at ``reset``.  Lineage is cut every few rounds only: a
    round is one join and one partially aggregated sum.
    """
    weighted = _out_weighted(graph)
    ranks = weighted.vertices.select("id", F.lit(reset).alias("rank"))
    for i in range(1, rounds + 1):
        shares = weighted.prepared.join_src(ranks).groupBy(F.col("dst").alias("id"))
        sums = shares.agg(F.sum(F.col("src_rank") * F.col("weight")).alias("s"))
        rank = reset + (1 - reset) * F.coalesce("s", F.lit(0.0))
        ranks = weighted.vertices.join(sums.hint("merge"), "id", "left").select("id", rank.alias("rank"))
        if i % cut_every == 0 and i < rounds:
            ranks = cut_lineage(ranks)
    return ranks


def pagerank_until(graph: Graph, tolerance: float, reset: float = 0.15, max_rounds: int = 200) -> DataFrame:
    """Rank by passing on changes until every change is at most ``tolerance``."""
    weighted = _out_weighted(graph)
    out = pregel(
        weighted,
        {"rank": F.lit(reset), "delta": F.lit(reset)},
        [Send("dst", {"m": F.col("src_delta") * F.col("weight")}, F.col("src_active") & (F.col("src_delta") > tolerance))],
        [F.sum("m").alias("m")],
        {"rank": F.col("rank") + (1 - reset) * F.col("m"), "delta": (1 - reset) * F.col("m")},
        max_rounds,
        active=F.col("delta") > tolerance,
        ends=("src",),
        must_end=True,
    )
    return out.select("id", "rank")


def _with_lowest(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the smallest v of their u as ``m``; a hub is salted by the counts of the same aggregation."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
    hot = hot_from_counts(low.select("u", "__n"), ["u"])
    right = repeat_per_salt(low.select("u", "m"), hot, ["u"])
    return add_salt(pairs, hot, ["u"]).join(right, ["u", "__salt"]).drop("__salt")


def connected_components(graph: Graph, max_rounds: int = 60) -> DataFrame:
    """Rows (id, component) with the smallest id of each component.

    Large-star and small-star rounds: the number of rounds grows with the
    logarithm of the longest chain, not with its length.
    """
    pairs = graph.edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    pairs = cut_lineage(pairs.filter("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is tied to the smallest around u
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: u and its smaller neighbours are tied to the smallest of them
        tied = F.explode(F.array(F.col("v"), F.col("u")))
        small = _with_lowest(large).select(tied.alias("u"), F.col("m").alias("v")).filter("u <> v")
        pairs = cut_lineage(small.distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise NotConverged(f"components after {max_rounds} rounds")
    return graph.vertices.select("id").join(
        pairs.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left"
    ).withColumn("component", F.coalesce("component", "id"))


def triangle_counts(graph: Graph) -> DataFrame:
    """Rows (id, triangles) over distinct undirected edges.

    Edges point from the endpoint of lower degree to the higher, so no vertex
    has more than sqrt(2 * edges) targets and its target list stays small even
    for a hub; a triangle is met once, as a common target of an edge's ends.
    """
    pairs = graph.edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pairs = cut_lineage(pairs.distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    degree = cut_lineage(ends.groupBy("id").agg(F.count("*").alias("d")))
    edges = pairs
    for end in ("a", "b"):
        hot = hot_from_counts(degree.select(F.col("id").alias(end), F.col("d").alias("__n")), [end])
        edges = salted_join(edges, degree.select(F.col("id").alias(end), F.col("d").alias(f"d{end}")), [end], hot=hot)
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    directed = edges.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    directed = cut_lineage(directed)
    targets = cut_lineage(directed.groupBy("u").agg(F.collect_set("v").alias("t")))
    # the number of edges into v is unbounded, so that join is the salted one
    with_u = directed.join(targets.withColumnRenamed("t", "tu"), "u")
    both = salted_join(with_u, targets.select(F.col("u").alias("v"), F.col("t").alias("tv")), ["v"])
    corners = both.select("u", "v", F.explode(F.array_intersect("tu", "tv")).alias("w"))
    counts = corners.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return graph.vertices.select("id").join(counts, "id", "left").fillna(0, ["triangles"])


def label_propagation(graph: Graph, rounds: int) -> DataFrame:
    """Rows (id, label): each round takes the label most frequent around, the smallest of ties."""
    edges = graph.prepared
    state = graph.vertices.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        from_src = edges.join_src(state).select(F.col("dst").alias("id"), F.col("src_label").alias("label"))
        from_dst = edges.join_dst(state).select(F.col("src").alias("id"), F.col("dst_label").alias("label"))
        votes = from_src.unionAll(from_dst).groupBy("id", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("b"))
        new = state.join(best.hint("merge"), "id", "left").select("id", F.coalesce(-F.col("b.minus"), F.col("label")).alias("label"))
        state = cut_lineage(new)
    return state


def shortest_paths(graph: Graph, landmarks: Sequence[int]) -> DataFrame:
    """Rows (id, landmark, hops) along edge direction, for every reachable landmark."""
    edges = graph.prepared
    start = graph.vertices.filter(F.col("id").isin(list(landmarks)))
    frontier = cut_lineage(start.select("id", F.col("id").alias("landmark"), F.lit(0).alias("hops")))
    found = [frontier]
    for hop in count(1):
        reached = edges.join_dst(frontier, many=True).select(F.col("src").alias("id"), F.col("dst_landmark").alias("landmark")).distinct()
        new = reached.join(union_all_of(found).select("id", "landmark").hint("merge"), ["id", "landmark"], "left_anti")
        frontier = cut_lineage(new.withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        found.append(frontier)
    return union_all_of(found)


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path, extending only the newest pairs each round.

    The result itself may grow with the square of the number of vertices.
    """
    base = cut_lineage(edges.select("src", "dst").distinct())
    steps = Graph.from_edges(base).prepared
    newest, pieces = base, [base]
    while True:
        ahead = newest.select(F.col("dst").alias("id"), F.col("src").alias("start"))
        found = steps.join_src(ahead, many=True).select(F.col("src_start").alias("src"), "dst").distinct()
        newest = cut_lineage(found.join(union_all_of(pieces).hint("merge"), ["src", "dst"], "left_anti"))
        if newest.isEmpty():
            break
        pieces.append(newest)
    return union_all_of(pieces)


def _vector_sum(column: str, rank: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(rank)])


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def svd_plus_plus(
    ratings: DataFrame, rank: int = 4, rounds: int = 2, low: float = 0.0, high: float = 5.0, bias_rate: float = 0.007,
    factor_rate: float = 0.007, bias_reg: float = 0.005, factor_reg: float = 0.015, seed: int = 0,
) -> tuple[DataFrame, float]:
    """Factors with implicit feedback on a bipartite rating graph (src user, dst item, rating).

    Returns rows (id, p, y, bias, norm, error) and the mean rating: ``p`` explicit
    factors, ``y`` implicit ones (for users: factors plus the scaled sum of their
    items' implicit factors), ``error`` the summed squared error of an item.
    """
    mean = ratings.agg(F.avg("rating")).first()[0]
    graph = Graph.from_edges(ratings.select("src", "dst", "rating"))

    def random_vector(salt):
        return F.array(*[F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt), F.lit(i)), F.lit(1 << 30)) / float(1 << 30) for i in range(rank)])

    edges = graph.prepared
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"), "rating")
    stats = ends.groupBy("id").agg(F.avg("rating").alias("bias"), (1 / F.sqrt(F.count("*"))).alias("norm"))
    state = cut_lineage(stats.select("id", random_vector(1).alias("p"), random_vector(2).alias("y"), "bias", "norm"))

    def predicted():
        raw = F.lit(mean) + F.col("src_bias") + F.col("dst_bias") + _dot(F.col("dst_p"), F.col("src_y"))
        return F.greatest(F.lit(low), F.least(F.lit(high), raw))

    for _ in range(rounds):
        # users: explicit factors plus scaled sum of the implicit factors of their items
        implicit = edges.join_dst(state.select("id", "y")).groupBy(F.col("src").alias("id")).agg(_vector_sum("dst_y", rank).alias("s"))
        state = state.join(implicit.hint("merge"), "id", "left")
        y = F.when(F.col("s").isNull(), F.col("y")).otherwise(_add(F.col("p"), _scale(F.col("s"), F.col("norm"))))
        state = cut_lineage(state.select("id", "p", y.alias("y"), "bias", "norm"))
        t = edges.triplets(state, rounds=True).withColumn("err", F.col("rating") - predicted())
        err, rate, reg = F.col("err"), F.lit(factor_rate), F.lit(-factor_reg)

        def step(gradient, current):
            return _scale(_add(gradient, _scale(current, reg)), rate)

        shared = step(_scale(F.col("dst_p"), err * F.col("src_norm")), F.col("dst_y"))
        to_user = {"dp": step(_scale(F.col("dst_p"), err), F.col("src_p")), "dy": shared, "db": (err - bias_reg * F.col("src_bias")) * bias_rate}
        to_item = {"dp": step(_scale(F.col("src_y"), err), F.col("dst_p")), "dy": shared, "db": (err - bias_reg * F.col("dst_bias")) * bias_rate}
        merge = [_vector_sum("dp", rank).alias("dp"), _vector_sum("dy", rank).alias("dy"), F.sum("db").alias("db")]
        delta = collect_messages(t, [Send("src", to_user), Send("dst", to_item)], merge)
        moved = state.join(delta.hint("merge"), "id")
        state = cut_lineage(
            moved.select("id", _add(F.col("p"), F.col("dp")).alias("p"), _add(F.col("y"), F.col("dy")).alias("y"),
                         (F.col("bias") + F.col("db")).alias("bias"), "norm")
        )
    squares = (F.col("rating") - predicted()) ** 2
    errors = edges.triplets(state).groupBy(F.col("dst").alias("id")).agg(F.sum(squares).alias("error"))
    return state.join(errors, "id", "left").fillna(0.0, ["error"]), mean
