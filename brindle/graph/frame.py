"""Property graph as two frames, and message passing over it.

Vertices have a column ``id``, edges ``src`` and ``dst``; all other columns are
attributes.  Joins of edges with vertex state are salted by the degree of the
endpoint, so a vertex that holds a third of the edges is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.grouping import group_lists
from brindle.operators.relational import add_salt, attach_row, hot_keys, repeat_per_salt
from brindle.session import cut_lineage, store_bucketed


class Graph:
    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges = vertices, edges

    # --- building ---------------------------------------------------------------------------

    @classmethod
    def from_edges(cls, edges: DataFrame) -> Graph:
        """Vertices are the distinct endpoints."""
        ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return cls(ids, edges)

    @classmethod
    def from_pairs(cls, pairs: DataFrame, unique: bool = True) -> Graph:
        """Edges from (src, dst) rows; with ``unique`` equal pairs merge into one with their count ``n``."""
        edges = pairs.select("src", "dst")
        return cls.from_edges(edges.groupBy("src", "dst").agg(F.count("*").alias("n")) if unique else edges)

    @classmethod
    def with_defaults(cls, vertices: DataFrame, edges: DataFrame, defaults: Mapping[str, Column]) -> Graph:
        """Endpoints that have no vertex row get one with default attributes."""
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        missing = ends.join(vertices.select("id"), "id", "left_anti")
        return cls(vertices.unionByName(missing.select("id", *[v.alias(k) for k, v in defaults.items()])), edges)

    # --- views and attribute maps -----------------------------------------------------------------

    @cached_property
    def prepared(self) -> PreparedEdges:
        return PreparedEdges(self.edges)

    def triplets(self) -> DataFrame:
        """Edges with the attributes of both ends as src_* and dst_*."""
        return self.prepared.triplets(self.vertices)

    def map_vertices(self, **columns: Column) -> Graph:
        return Graph(self.vertices.withColumns(columns), self.edges)

    def map_edges(self, **columns: Column) -> Graph:
        return Graph(self.vertices, self.edges.withColumns(columns))

    def map_triplets(self, **columns: Column) -> Graph:
        """New edge attributes from expressions over edge, src_* and dst_* columns."""
        kept = [F.col(c) for c in self.edges.columns if c not in columns]
        return Graph(self.vertices, self.triplets().select(*kept, *[v.alias(k) for k, v in columns.items()]))

    def reverse(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))

    def subgraph(self, vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """Vertices that pass, and edges that pass (over triplet columns) between them."""
        kept = self.vertices if vertex is None else self.vertices.filter(vertex)
        edges = Graph(kept, self.edges).triplets() if edge is not None else self.prepared.triplets(kept.select("id"))
        if edge is not None:
            edges = edges.filter(edge)
        return Graph(kept, edges.select(*self.edges.columns))

    def mask(self, other: Graph) -> Graph:
        """What also exists in the other graph, with this graph's attributes."""
        pairs = other.edges.select("src", "dst").distinct()
        return Graph(
            self.vertices.join(other.vertices.select("id"), "id", "left_semi"),
            self.edges.join(pairs, ["src", "dst"], "left_semi"),
        )

    def group_edges(self, *aggs: Column) -> Graph:
        """Parallel edges merged by aggregates over their attributes."""
        return Graph(self.vertices, self.edges.groupBy("src", "dst").agg(*aggs))

    def outer_join_vertices(self, other: DataFrame) -> Graph:
        return Graph(self.vertices.join(other, "id", "left"), self.edges)

    def join_vertices(self, other: DataFrame, column: str, value: Column) -> Graph:
        """``column`` replaced by ``value`` (over both rows) where the other frame has the id."""
        marked = self.vertices.join(other.withColumn("__hit", F.lit(True)), "id", "left")
        new = F.when(F.col("__hit"), value).otherwise(F.col(column))
        kept = [new.alias(c) if c == column else F.col(c) for c in self.vertices.columns]
        return Graph(marked.select(*kept), self.edges)

    # --- neighbourhoods ----------------------------------------------------------------------------

    def directed_pairs(self, direction: str) -> DataFrame:
        """Rows (id, nbr): for ``out`` nbr = dst, for ``in`` nbr = src, ``either`` both, ``both`` mutual ones."""
        out = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"))
        into = self.edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"))
        if direction == "both":
            return out.intersect(into)
        return {"out": out, "in": into, "either": out.unionAll(into)}[direction]

    def degrees(self, direction: str = "either") -> DataFrame:
        """Rows (id, degree); vertices without such edges are absent."""
        return self.directed_pairs(direction).groupBy("id").agg(F.count("*").alias("degree"))

    def neighbor_ids(self, direction: str = "either") -> DataFrame:
        """Rows (id, chunk, neighbors); a very large neighbourhood comes in several chunks."""
        return group_lists(self.directed_pairs(direction), "id", F.col("nbr"), "neighbors")

    def neighbors(self, direction: str = "either") -> DataFrame:
        """Rows (id, chunk, neighbors) where each neighbor is its vertex row."""
        pairs = Graph(self.vertices, self.directed_pairs(direction).select(F.col("nbr").alias("src"), F.col("id").alias("dst")))
        rows = pairs.prepared.join_src(self.vertices, pairs.prepared.base).withColumnRenamed("dst", "id")
        fields = [F.col("src").alias("id")] + [F.col(f"src_{c}").alias(c) for c in self.vertices.columns if c != "id"]
        return group_lists(rows, "id", F.struct(*fields), "neighbors")

    def edge_lists(self, direction: str = "either") -> DataFrame:
        """Rows (id, chunk, edges) with the edges at each vertex."""
        edge = F.struct(*self.edges.columns)
        ends = {"out": ["src"], "in": ["dst"], "either": ["src", "dst"]}[direction]
        rows = reduce(DataFrame.unionAll, [self.edges.select(F.col(e).alias("id"), edge.alias("e")) for e in ends])
        return group_lists(rows, "id", F.col("e"), "edges")

    def aggregate_messages(self, sends: Sequence[Send], merge: Sequence[Column]) -> DataFrame:
        """Messages along triplets, combined per receiving vertex: rows (id, merged...)."""
        return collect_messages(self.triplets(), sends, merge)


@dataclass(frozen=True)
class Send:
    """A message to one end (``src`` or ``dst``) of every triplet that passes ``when``."""

    to: str
    values: Mapping[str, Column]
    when: Column | None = None


def collect_messages(triplets: DataFrame, sends: Sequence[Send], merge: Sequence[Column]) -> DataFrame:
    """One pass over the triplets whatever the number of sends; partial aggregation before the shuffle."""
    names = list(sends[0].values)
    options = [
        F.when(
            F.lit(True) if s.when is None else s.when,
            F.struct(F.col(s.to).alias("id"), *[s.values[n].alias(n) for n in names]),
        )
        for s in sends
    ]
    messages = triplets.select(F.explode(F.array(*options)).alias("m")).filter("m IS NOT NULL").select("m.*")
    return messages.groupBy("id").agg(*merge)


class PreparedEdges:
    """Edges kept for many rounds of joins with vertex state.

    They are written in buckets of the endpoint (and of a salt, for hot
    endpoints), once per endpoint that is joined on, so a round shuffles state
    and messages but not the edges.  State is merged, never broadcast: it is of
    the graph's size, and would pass through the driver in every round.  Where no
    endpoint is hot there are no salts, nor a list of them to send out.
    """

    def __init__(self, edges: DataFrame):
        self.base = cut_lineage(edges)
        self.count = self.base.count()
        self._hot: dict[str, DataFrame] = {}
        self._any_hot: dict[str, bool] = {}
        self._stored: dict[str, DataFrame] = {}

    def hot(self, end: str) -> DataFrame:
        if end not in self._hot:
            self._hot[end] = cut_lineage(hot_keys(self.base, [end]))
        return self._hot[end]

    def any_hot(self, end: str) -> bool:
        if end not in self._any_hot:
            self._any_hot[end] = not self.hot(end).isEmpty()
        return self._any_hot[end]

    def stored(self, end: str) -> DataFrame:
        """The edges in buckets; with the column ``__salt`` where an endpoint is hot."""
        if end not in self._stored:
            salted, keys = (add_salt(self.base, self.hot(end), [end]), [end, "__salt"]) if self.any_hot(end) else (self.base, [end])
            self._stored[end] = store_bucketed(salted, keys, self.count, f"edges_{end}")
        return self._stored[end]

    def join(self, state: DataFrame, end: str, edges: DataFrame | None = None, many: bool = False) -> DataFrame:
        """Edges (or rows made from them) with the state of one end as {end}_* columns.

        ``many`` says that a vertex may have many rows of state: those of hot
        vertices are spread over salts of their own, and the edges repeated for them.
        """
        renamed = state.select(*[F.col(c).alias(end if c == "id" else f"{end}_{c}") for c in state.columns])
        salted = self.any_hot(end)
        left = self.stored(end) if edges is None else add_salt(edges, self.hot(end), [end]) if salted else edges
        hot = hot_keys(renamed, [end]) if many else None
        right = add_salt(renamed, hot, [end], "__state_salt") if many else renamed
        right = repeat_per_salt(right, self.hot(end), [end]) if salted else right
        left = repeat_per_salt(left, hot, [end], "__state_salt") if many else left
        salts = ["__salt"] * salted + ["__state_salt"] * many
        return left.join(right.hint("merge"), [end, *salts]).drop(*salts)

    def join_src(self, state: DataFrame, edges: DataFrame | None = None, many: bool = False) -> DataFrame:
        return self.join(state, "src", edges, many)

    def join_dst(self, state: DataFrame, edges: DataFrame | None = None, many: bool = False) -> DataFrame:
        return self.join(state, "dst", edges, many)

    def triplets(self, state: DataFrame, rounds: bool = False) -> DataFrame:
        """Edges with both ends; ``rounds`` uses the stored copy, worth its writing when asked again and again."""
        return self.join(state, "dst", self.join(state, "src", None if rounds else self.base))


class NotConverged(RuntimeError):
    """The rounds allowed were not enough; an unfinished state is never returned."""


def pregel(
    graph: Graph,
    init: Mapping[str, Column],
    sends: Sequence[Send],
    merge: Sequence[Column],
    update: Mapping[str, Column],
    max_rounds: int | None,
    active: Column | None = None,
    ends: Sequence[str] = ("src", "dst"),
    aggregator: Column | None = None,
    must_end: bool = False,
) -> DataFrame:
    """Rounds of send, combine, update until no vertex changes or ``max_rounds``; None is no limit.

    The state after the last allowed round is the result, unless ``must_end`` makes that an error.

    ``init`` gives the state columns.  ``sends`` read src_*, dst_* and edge
    columns of the ends named in ``ends``, which also have src_active and
    dst_active.  ``merge`` aggregates the message columns; ``update`` computes
    new state columns from old state and merged messages, for receiving vertices
    only; ``active`` (over state columns and old_*) says which of them changed.
    ``aggregator`` is a global aggregate of the state, given to the next round's
    update as the column ``total``.
    """
    names = list(init)
    edges = graph.prepared
    state = cut_lineage(graph.vertices.select("id", *[c.alias(n) for n, c in init.items()]).withColumn("active", F.lit(True)))
    for _ in count() if max_rounds is None else range(max_rounds):
        triplets = None
        for end in ends:
            triplets = edges.join(state, end, triplets)
        merged = collect_messages(triplets, sends, merge).withColumn("__got", F.lit(True))
        joined = state.join(merged.hint("merge"), "id", "left")
        if aggregator is not None:
            joined = attach_row(joined, state.agg(aggregator.alias("total")))
        got = F.col("__got")
        new = joined.select(
            "id",
            *[F.col(n).alias(f"old_{n}") for n in names],
            *[F.when(got, update[n]).otherwise(F.col(n)).alias(n) if n in update else F.col(n) for n in names],
            F.coalesce(got, F.lit(False)).alias("__got"),
        )
        changed = reduce(lambda a, b: a | b, [~F.col(n).eqNullSafe(F.col(f"old_{n}")) for n in names])
        state = cut_lineage(new.select("id", *names, (F.col("__got") & (changed if active is None else active)).alias("active")))
        if state.filter("active").isEmpty():
            break
    else:
        if must_end:
            raise NotConverged(f"vertices still change after {max_rounds} rounds")
    return state.drop("active")


def place_edges(edges: DataFrame, parts: int, how: str) -> DataFrame:
    """Edges repartitioned by a placement rule.

    ``1d``: by source; ``2d``: source picks the column and target the row of a
    square of parts, so a vertex meets at most 2 * sqrt(parts) parts;
    ``random``: by the directed pair; ``canonical``: by the unordered pair.
    """
    side = max(1, int(parts**0.5))
    keys = {
        "1d": F.pmod(F.xxhash64("src"), F.lit(parts)),
        "2d": F.pmod(F.xxhash64("src"), F.lit(side)) * side + F.pmod(F.xxhash64("dst"), F.lit(side)),
        "random": F.pmod(F.xxhash64("src", "dst"), F.lit(parts)),
        "canonical": F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.lit(parts)),
    }
    return edges.repartition(parts, keys[how])
