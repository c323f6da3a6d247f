"""Message passing that goes on as long as messages are received, whether or not they change anything."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.graph.frame import Graph, PreparedEdges, Send, collect_messages
from brindle.session import cut_lineage

#: Which edges carry a message on: by the end, or ends, that received one in the last round.
DIRECTIONS = ("out", "in", "either", "both")


def message_passing(
    graph: Graph,
    start: Mapping[str, Column],
    initial: Mapping[str, Column],
    sends: Sequence[Send],
    merge: Sequence[Column],
    update: Mapping[str, Column],
    max_rounds: int | None = None,
    direction: str = "either",
    ends: Sequence[str] = ("src", "dst"),
) -> DataFrame:
    """State (id, columns of ``start``) when a round sends no message, or after ``max_rounds`` of them.

    Before the first round every vertex receives ``initial``, values for the
    columns that ``merge`` makes.  ``update`` has new state columns over the
    state and these columns.  ``sends`` read src_*, dst_* and edge columns of the
    ends named in ``ends``; an edge is looked at if its source (``out``), its
    target (``in``), one of them (``either``) or each of them (``both``)
    received a message in the round before.  A vertex without message keeps its
    state and goes quiet until it is sent one.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    if clash := set(start) & set(initial):
        raise ValueError(f"state and message columns share names: {', '.join(sorted(clash))}")
    names, edges = list(start), graph.prepared
    first = graph.vertices.select("id", *[c.alias(n) for n, c in start.items()]).withColumns(dict(initial))
    state = cut_lineage(first.select("id", *[update.get(n, F.col(n)).alias(n) for n in names], F.lit(True).alias("active")))
    for done in count():
        if done == max_rounds:
            break
        messages = cut_lineage(collect_messages(_live_triplets(edges, state, direction, ends), sends, merge))
        if messages.isEmpty():
            break
        joined = state.drop("active").join(messages.withColumn("active", F.lit(True)).hint("merge"), "id", "left")
        got = F.coalesce("active", F.lit(False))
        new = [F.when(got, update[n]).otherwise(F.col(n)).alias(n) if n in update else F.col(n) for n in names]
        state = cut_lineage(joined.select("id", *new, got.alias("active")))
    return state.drop("active")


def _live_triplets(edges: PreparedEdges, state: DataFrame, direction: str, ends: Sequence[str]) -> DataFrame:
    """Edges with the ends asked for; the receivers alone go into the first join where one end decides."""
    receivers = state.filter("active")
    needed = {"out": ("src",), "in": ("dst",), "both": ("src", "dst"), "either": ("src", "dst")}[direction]
    out = None
    for end in needed:
        out = edges.join(state if direction == "either" else receivers, end, out)
    for end in ends:
        if end not in needed:
            out = edges.join(state, end, out)
    return out.filter("src_active OR dst_active") if direction == "either" else out
