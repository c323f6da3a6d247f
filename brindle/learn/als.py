"""Alternating least squares over blocks: each factor is sent once to every block that needs it."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import MAX_BUCKETS, scratch_path

#: Ratings that one task solves for; a block with more is split by the other side.
UNIT = 1_000_000

IN_LINKS = "block long, part long, src binary, dst binary, rating binary"
FACTORS = "block long, ids binary, cells binary"
SUMS = "block long, ids binary, cells binary, whole boolean"


@dataclass
class Side:
    """What is built once for the side that is solved for.

    ``links`` holds the ratings as in-link units (block, part): places of the
    other side's ids in the unit's list of them, and places of own ids.
    ``needs`` are the out-links of the other side: (block of the id, id, unit).
    """

    links: DataFrame
    needs: DataFrame
    blocks: int
    parts: DataFrame


def _packed(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _table(schema: str, **columns) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _stored(df: DataFrame, keys: tuple[str, ...], buckets: int, path: str) -> DataFrame:
    """Written in buckets of ``keys``, by which the rows are dealt to tasks: groups and joins read them in place, round after round."""
    name = f"brindle_als_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def _side(ratings: DataFrame, own: str, other: str, rows: int, other_blocks: int, folder: str) -> Side:
    """Write in-links and out-links; the ratings are read here and not again."""
    spark = ratings.sparkSession
    blocks = max(1, -(-rows // UNIT))
    here = F.pmod(F.xxhash64(own), F.lit(blocks))
    sizes = ratings.groupBy(here.alias("block")).agg(F.ceil(F.count("*") / UNIT).cast("long").alias("parts"))
    sizes.write.parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")  # one row per block
    placed = ratings.select(F.col(other).alias("src"), F.col(own).alias("dst"), F.col("rating").cast("double").alias("rating"), here.alias("block"))
    placed = placed.join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("src", F.lit(7)), F.col("parts"))).drop("parts")

    def unit(found: pa.Table) -> pa.Table:
        src, dst, rating = (found.column(c).to_numpy() for c in ("src", "dst", "rating"))
        order = np.argsort(dst, kind="stable")
        ids = np.unique(src)
        return _table(
            IN_LINKS, block=[found.column("block")[0].as_py()], part=[found.column("part")[0].as_py()],
            src=[_packed(ids, "<i8") + _packed(np.searchsorted(ids, src[order]), "<i4")], dst=[_packed(dst[order], "<i8")], rating=[_packed(rating[order], "<f8")],
        )

    units = min(parts.agg(F.sum("parts")).first()[0] or 1, MAX_BUCKETS)
    dealt = placed.repartition(units, "block", "part").groupBy("block", "part")
    links = _stored(dealt.applyInArrow(unit, IN_LINKS), ("block", "part"), units, f"{folder}/links")

    def wanted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, blob, n in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "src", "n")), strict=True):
                ids = np.frombuffer(blob, "<i8", (len(blob) - 4 * n) // 8)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), block)), pa.array(np.full(len(ids), part))], ["id", "to", "part"])

    each = links.select("block", "part", "src", (F.octet_length("rating") / 8).cast("int").alias("n")).mapInArrow(wanted, "id long, to long, part long")
    needs = each.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(other_blocks)))

    def lists(found: pa.Table) -> pa.Table:
        ids = np.sort(found.column("id").to_numpy())
        first = {c: [found.column(c)[0].as_py()] for c in ("block", "to", "part")}
        return pa.table({**first, "ids": pa.array([_packed(ids, "<i8")], pa.binary())})

    buckets = min(other_blocks, MAX_BUCKETS)
    listed = needs.repartition(buckets, "block").groupBy("block", "to", "part").applyInArrow(lists, "block long, to long, part long, ids binary")
    return Side(links, _stored(listed, ("block",), buckets, f"{folder}/needs"), blocks, parts)


def _solved(ids: np.ndarray, sums: np.ndarray, rank: int, reg: float) -> np.ndarray:
    square, right = sums[:, : rank * rank].reshape(-1, rank, rank), sums[:, rank * rank :]
    return np.linalg.solve(square + reg * np.eye(rank), right[:, :, None])[:, :, 0]


def _half_round(side: Side, factors: DataFrame, rank: int, reg: float, path: str) -> DataFrame:
    """Factors of ``side`` from those of the other one."""
    spark = factors.sparkSession

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a block's factors those that a unit needs, in the order of its list."""
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("to", "part", "wanted", "ids", "cells")), strict=True)
            for to, part, wanted, ids, cells in rows:
                have = np.frombuffer(ids, "<i8")
                at = np.searchsorted(have, np.frombuffer(wanted, "<i8"))
                picked = np.frombuffer(cells, "<f8").reshape(-1, rank)[at]
                yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([part]), pa.array([wanted], pa.binary()), pa.array([_packed(picked, "<f8")], pa.binary())], ["block", "part", "ids", "cells"])

    asked = side.needs.withColumnRenamed("ids", "wanted").join(factors, "block").select("to", "part", "wanted", "ids", "cells")
    sent = asked.mapInArrow(send, "block long, part long, ids binary, cells binary")
    whole = {r.block: r.parts == 1 for r in side.parts.collect()}  # as many as there are blocks

    def solve(links: pa.Table, given: pa.Table) -> pa.Table:
        if not links.num_rows:
            return _table(SUMS, block=[], ids=[], cells=[], whole=[])
        block, rating, dst = links.column("block")[0].as_py(), *(np.frombuffer(links.column(c)[0].as_py(), k) for c, k in (("rating", "<f8"), ("dst", "<i8")))
        blob = links.column("src")[0].as_py()
        wanted = np.frombuffer(blob, "<i8", (len(blob) - 4 * len(rating)) // 8)
        place = np.frombuffer(blob, "<i4", len(rating), 8 * len(wanted))
        got = np.concatenate([np.frombuffer(b, "<i8") for b in given.column("ids").to_pylist()])
        x = np.concatenate([np.frombuffer(b, "<f8").reshape(-1, rank) for b in given.column("cells").to_pylist()])
        x = x[np.argsort(got)][place]
        heads = np.flatnonzero(np.diff(dst, prepend=dst[0] - 1))
        columns = [np.add.reduceat(x[:, i] * x[:, j], heads) for i in range(rank) for j in range(rank)] + [np.add.reduceat(x[:, i] * rating, heads) for i in range(rank)]
        sums, ids = np.column_stack(columns), dst[heads]
        cells = _solved(ids, sums, rank, reg) if whole[block] else sums
        return _table(SUMS, block=[block], ids=[_packed(ids, "<i8")], cells=[_packed(cells, "<f8")], whole=[whole[block]])

    partial = side.links.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInArrow(solve, SUMS)

    def together(found: pa.Table) -> pa.Table:
        """Blocks in one unit are solved already; sums of the units of others are added first."""
        block, ids, cells = found.column("block")[0].as_py(), found.column("ids").to_pylist(), found.column("cells").to_pylist()
        if found.column("whole")[0].as_py():
            return _table(FACTORS, block=[block], ids=ids, cells=cells)
        every = np.concatenate([np.frombuffer(b, "<i8") for b in ids])
        sums = np.concatenate([np.frombuffer(b, "<f8").reshape(-1, rank * rank + rank) for b in cells])
        order = np.argsort(every, kind="stable")
        heads = np.flatnonzero(np.diff(every[order], prepend=every[order][0] - 1))
        total = np.add.reduceat(sums[order], heads, axis=0)
        ids = every[order][heads]
        return _table(FACTORS, block=[block], ids=[_packed(ids, "<i8")], cells=[_packed(_solved(ids, total, rank, reg), "<f8")])

    partial.groupBy("block").applyInArrow(together, FACTORS).write.parquet(path)
    return spark.read.parquet(path)


def _unpacked(factors: DataFrame, rank: int, name: str, kind: str) -> DataFrame:
    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, cells in zip(batch.column("ids").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                n = len(ids) // 8
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * rank)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8")), pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(cells, "<f8")))], [name, "factors"])

    return factors.select("ids", "cells").mapInArrow(spread, f"`{name}` long, factors array<double>").withColumn(name, F.col(name).cast(kind))


def als(ratings: DataFrame, rank: int, rounds: int, reg: float, start: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(user, factors) and (item, factors) of ``ratings(user, item, rating)`` after rounds of users then items.

    Squared error plus ``reg`` times the squared length of every factor.  Items
    begin at ``start`` in every place, or at random numbers from their id.
    Ratings are worked out once and written, and read from there to build who
    needs whose factor; a round moves factors, each once per unit of up to
    ``UNIT`` ratings that needs it, and never a rating.  An id with more ratings than that is solved from sums
    of several units.  Rows with a null are left out, repeated ones count each.
    """
    kinds = dict(ratings.dtypes)
    spark, folder = ratings.sparkSession, scratch_path(ratings.sparkSession, "als")
    rows = ratings.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), F.col("rating").cast("double").alias("rating")).dropna()
    rows.write.parquet(f"{folder}/ratings")
    rows = spark.read.parquet(f"{folder}/ratings")
    n = rows.count()
    blocks = max(1, -(-n // UNIT))
    users = _side(rows, "user", "item", n, blocks, f"{folder}/users")
    items = _side(rows, "item", "user", n, blocks, f"{folder}/items")

    def first(found: pa.Table) -> pa.Table:
        ids = np.unique(np.concatenate([np.frombuffer(b, "<i8") for b in found.column("ids").to_pylist()]))
        if start is None:
            cells = np.stack([np.abs(np.random.default_rng([seed, int(i) & 0xFFFFFFFF, int(i) >> 32 & 0xFFFFFFFF]).standard_normal(rank)) for i in ids])
            cells /= np.linalg.norm(cells, axis=1, keepdims=True)
        else:
            cells = np.full((len(ids), rank), start)
        return _table(FACTORS, block=[found.column("block")[0].as_py()], ids=[_packed(ids, "<i8")], cells=[_packed(cells, "<f8")])

    users.needs.select("block", "ids").groupBy("block").applyInArrow(first, FACTORS).write.parquet(f"{folder}/start")
    of_items, of_users = spark.read.parquet(f"{folder}/start"), None
    for k in range(rounds):
        of_users = _half_round(users, of_items, rank, reg, f"{folder}/users-{k}")
        of_items = _half_round(items, of_users, rank, reg, f"{folder}/items-{k}")
    if of_users is None:
        raise ValueError("at least one round")
    return _unpacked(of_users, rank, "user", kinds["user"]), _unpacked(of_items, rank, "item", kinds["item"])
