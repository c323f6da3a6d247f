"""Synthetic graphs, made on the executors from a frame of vertex ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.graph.frame import Graph


def _unit(seed: int, salt: int, *cols):
    return F.pmod(F.xxhash64(*cols, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)


def star(ids: DataFrame, center: int = 0) -> Graph:
    """Every other vertex points at the center."""
    edges = ids.filter(F.col("id") != center).select(F.col("id").alias("src"), F.lit(center).cast("long").alias("dst"))
    return Graph(ids, edges)


def grid(ids: DataFrame, columns: int) -> Graph:
    """Ids 0..n-1 as rows of ``columns`` cells, each pointing right and down."""
    total = ids.count()
    right = F.when((F.col("id") % columns < columns - 1) & (F.col("id") + 1 < total), F.col("id") + 1)
    down = F.when(F.col("id") + columns < total, F.col("id") + columns)
    edges = ids.select(F.col("id").alias("src"), F.explode(F.array(right, down)).alias("dst")).filter("dst IS NOT NULL")
    return Graph(ids, edges)


def log_normal(ids: DataFrame, mu: float = 4.0, sigma: float = 1.3, seed: int = 0) -> Graph:
    """Out-degrees exp(N(mu, sigma)), cut at the number of vertices; targets uniform over 0..n-1."""
    total = ids.count()
    gauss = F.sqrt(-2 * F.log(1 - _unit(seed, 1, "id"))) * F.cos(2 * F.pi() * _unit(seed, 2, "id"))
    degree = F.least(F.lit(total), F.exp(gauss * sigma + mu).cast("long"))
    vertices = ids.select("id", degree.alias("degree"))
    slots = vertices.filter("degree > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("degree"))).alias("i"))
    target = F.floor(_unit(seed, 3, "id", "i") * total)
    return Graph(vertices, slots.select(F.col("id").alias("src"), target.alias("dst"), F.col("i").alias("n")))


def r_mat(slots: DataFrame, levels: int, seed: int = 0, a: float = 0.45, b: float = 0.15, c: float = 0.15) -> Graph:
    """Edges by recursive quadrants: one edge per row of ``slots`` (column id) over 2^levels vertices."""
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in range(levels):
        u = _unit(seed, 10 + level, "id")
        src = src * 2 + F.when(u >= a + b, 1).otherwise(0)
        dst = dst * 2 + F.when(((u >= a) & (u < a + b)) | (u >= a + b + c), 1).otherwise(0)
    edges = slots.select(src.alias("src"), dst.alias("dst")).distinct()
    return Graph.from_edges(edges)
