"""Strong components: paths shortened by doubling, then reach in both directions from random pivots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.graph.frame import Graph, NotConverged
from brindle.operators.relational import union_all_of
from brindle.session import cut_lineage

#: Self-joins between two writes of the pointers: 4 steps of a path become one.
JUMP = 4


@dataclass
class Contracted:
    """Vertices taken out of a graph, each with the only vertex that its edges lead to.

    ``hops`` has per level (id, to): the vertex 4^level steps on, or the end of
    the path.  ``entries`` has edges into the paths from vertices that stay.
    """

    hops: list[DataFrame]
    roots: DataFrame
    entries: DataFrame

    def expanded(self, found: DataFrame) -> DataFrame:
        """``found(id, root)`` of the vertices that stayed, with those of the paths.

        A vertex of a path shares the component of the path's end just if that
        component leads back into the path at or before it.
        """
        end = self.roots.join(found.withColumnRenamed("id", "to"), "to").select("id", "root")
        back = self.entries.join(found.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "root")
        marked = cut_lineage(back.join(end, ["id", "root"]).select("id").distinct())
        for level in self.hops:
            steps = [marked]
            for _ in range(JUMP - 1):
                steps.append(steps[-1].join(level, "id").select(F.col("to").alias("id")))
            marked = cut_lineage(union_all_of(steps).distinct())
        inside = end.join(marked.withColumn("in", F.lit(True)), "id", "left")
        return found.unionByName(inside.select("id", F.when(F.col("in"), F.col("root")).otherwise(F.col("id")).alias("root")))


def _contract(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, Contracted | None, DataFrame | None]:
    """Take out the vertices with one out-edge: a way through such a vertex is a way through its successor.

    Gives the vertices and edges that stay, how to bring the others back, and
    the components of paths that end in themselves.
    """
    single = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).filter("n = 1")
    path = cut_lineage(single.select(F.col("src").alias("id"), "to"))
    members = path.count()
    if not members:
        return vertices, edges, None, None
    inside = path.select(F.col("id").alias("to"), F.lit(True).alias("on"))
    hops, now, reach = [path], path, 1
    while True:
        longer = now
        for _ in range(JUMP - 1):
            ahead = now.select(F.col("id").alias("to"), F.col("to").alias("then"))
            longer = longer.join(ahead, "to", "left").select("id", F.coalesce("then", "to").alias("to"))
        now, reach = cut_lineage(longer), reach * JUMP
        open_ = cut_lineage(now.join(inside, "to", "left_semi"))
        if open_.isEmpty() or reach > members:
            break
        hops.append(now)
    stay = vertices.join(path.select("id"), "id", "left_anti")
    closed = None
    if reach > members and not open_.isEmpty():
        # What is still on a path after so many steps is on a ring, and the rest of those leads into it.
        ring = open_.select(F.col("to").alias("id")).distinct()
        low = cut_lineage(ring.withColumn("root", F.col("id")))
        for level in [*hops, now]:
            ahead = level.select(F.col("id").alias("at"), "to")
            steps = [low.select("id", F.col("id").alias("at"))]
            for _ in range(JUMP - 1):
                steps.append(steps[-1].join(ahead, "at").select("id", F.col("to").alias("at")))
            met = union_all_of(steps).join(low.select(F.col("id").alias("at"), "root"), "at")
            low = cut_lineage(met.groupBy("id").agg(F.min("root").alias("root")))
        alone = open_.select("id").join(ring, "id", "left_anti").withColumn("root", F.col("id"))
        closed = cut_lineage(low.unionByName(alone))
        now = now.join(open_.select("id"), "id", "left_anti")
    roots = cut_lineage(now)
    moved = edges.join(path.select(F.col("id").alias("src")), "src", "left_anti")
    ends = roots.select(F.col("id").alias("dst"), F.col("to").alias("end"))
    entries = cut_lineage(moved.join(path.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    if closed is not None:
        moved = moved.join(closed.select(F.col("id").alias("dst")), "dst", "left_anti")
    left = moved.join(ends, "dst", "left").select("src", F.coalesce("end", "dst").alias("dst")).filter("src <> dst").distinct()
    return cut_lineage(stay), cut_lineage(left), Contracted(hops, roots, entries), closed


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _pivots(vertices: DataFrame, edges: DataFrame, seed: int, max_rounds: int) -> DataFrame:
    """(id, f, b): the lowest pivot that reaches a vertex and the lowest one it reaches, in a random order.

    A round looks along the edges and also asks the pivot found so far for the
    pivot that it has found itself, so that ways double in length.
    """
    rank = F.struct(F.xxhash64(F.lit(seed), "id").alias("rank"), "id")
    state = cut_lineage(vertices.select("id", rank.alias("f"), rank.alias("b"), F.lit(True).alias("moved")))
    for _ in range(max_rounds):
        none = F.lit(None).cast(state.schema["f"].dataType)
        source = state.select(F.col("id").alias("src"), F.col("f").alias("m"))
        target = state.select(F.col("id").alias("dst"), F.col("b").alias("m"))
        along = edges.join(source, "src").select(F.col("dst").alias("id"), F.col("m").alias("f"), none.alias("b"))
        against = edges.join(target, "dst").select(F.col("src").alias("id"), none.alias("f"), F.col("m").alias("b"))
        asked = state.select(F.col("f.id").alias("p"), "id").join(state.select(F.col("id").alias("p"), "f"), "p").select("id", "f", none.alias("b"))
        answered = state.select(F.col("b.id").alias("p"), "id").join(state.select(F.col("id").alias("p"), "b"), "p").select("id", none.alias("f"), "b")
        best = union_all_of([along, against, asked, answered]).groupBy("id").agg(F.min("f").alias("nf"), F.min("b").alias("nb"))
        f, b = F.least("f", F.coalesce("nf", "f")), F.least("b", F.coalesce("nb", "b"))
        new = state.join(best, "id", "left").select("id", f.alias("f"), b.alias("b"), ((f != F.col("f")) | (b != F.col("b"))).alias("moved"))
        state = cut_lineage(new)
        if state.filter("moved").isEmpty():
            return state.select("id", F.col("f.id").alias("f"), F.col("b.id").alias("b"))
    raise NotConverged(f"reach after {max_rounds} rounds")


def strongly_connected_components(graph: Graph, max_rounds: int = 1000, seed: int = 0) -> DataFrame:
    """Rows (id, component) with the smallest id of each strong component.

    Each round first takes out vertices with a single out-edge or a single
    in-edge, whole paths and rings of them by doubling, and vertices without
    one.  Then every vertex learns the lowest pivot, in a new random order, that
    reaches it and the lowest that it reaches.  Where both are the same, that is
    its component.  Others differ between components, so edges between vertices
    with different pivots go, and the parts go on by themselves.
    """
    vertices = cut_lineage(graph.vertices.select("id").distinct())
    edges = cut_lineage(graph.edges.select("src", "dst").filter("src <> dst").distinct())
    found: list[DataFrame] = []
    steps: list[tuple[list[DataFrame], Contracted | None]] = []
    for number in range(max_rounds):
        for turn in (lambda e: e, _reversed):
            vertices, turned, gone, closed = _contract(vertices, turn(edges))
            edges = turn(turned)
            steps.append(([closed] if closed is not None else [], gone))
        inner = edges.select(F.col("src").alias("id")).intersect(edges.select(F.col("dst").alias("id")))
        inner = cut_lineage(inner)
        steps.append(([vertices.join(inner, "id", "left_anti").withColumn("root", F.col("id"))], None))
        vertices = inner
        if vertices.isEmpty():
            break
        for end in ("src", "dst"):
            edges = edges.join(vertices.withColumnRenamed("id", end), end, "left_semi")
        edges = cut_lineage(edges.select("src", "dst"))
        seen = cut_lineage(_pivots(vertices, edges, seed + number, max_rounds))
        steps.append(([seen.filter("f = b").select("id", F.col("f").alias("root"))], None))
        rest = seen.filter("f <> b")
        for end in ("src", "dst"):
            edges = edges.join(rest.select(F.col("id").alias(end), F.col("f").alias(f"{end}_f"), F.col("b").alias(f"{end}_b")), end)
        edges = cut_lineage(edges.filter("src_f = dst_f AND src_b = dst_b").select("src", "dst"))
        vertices = cut_lineage(rest.select("id"))
    else:
        raise NotConverged(f"strong components after {max_rounds} rounds")
    done = vertices.select("id", F.col("id").alias("root"))
    for parts, gone in reversed(steps):
        done = union_all_of([done, *parts])
        if gone is not None:
            done = cut_lineage(gone.expanded(cut_lineage(done)))
    lowest = done.groupBy("root").agg(F.min("id").alias("component"))
    return done.join(lowest, "root").select("id", "component")
