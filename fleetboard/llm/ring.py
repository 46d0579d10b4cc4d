"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of the ring; a key belongs to the next point
clockwise.  A shard takes rows up to its capacity, and what does not fit goes
on clockwise to the next shard with room.  Only the counts of the ring's arcs, a
fixed number of them, reach the driver.  Rows are numbered in cells of the ring,
of which there are as many as the count of rows asks for.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free

BITS = 48
CELL_ROWS = 20_000


@dataclass(frozen=True)
class Ring:
    """The points of the ring in clockwise order and the shards that own them."""

    points: tuple[int, ...]
    owners: tuple[int, ...]

    @classmethod
    def of(cls, shards: int, vnodes: int) -> Ring:
        def point(s: int, v: int) -> int:
            digest = hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()
            return int.from_bytes(digest, "big") >> (64 - BITS)

        placed: dict[int, int] = {}
        for s in range(shards):
            for v in range(vnodes):
                placed.setdefault(point(s, v), s)
        points = tuple(sorted(placed))
        return cls(points, tuple(placed[p] for p in points))


def capacities(rows: int, shards: int, load_factor: float) -> list[int]:
    """Rows that each shard may take: at factor 1 the floor or the ceiling of the
    mean, above it the ceiling of factor times the mean."""
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil(load_factor * rows / shards)] * shards


def place(counts: list[int], owners: tuple[int, ...], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the rows of every arc go.

    Rounds: each shard admits, in ring order, the rows that stand at its points;
    what does not fit moves clockwise to the next shard with room.
    """
    room, used = list(caps), [0] * len(caps)
    arcs, out = len(owners), []
    waiting = [(arc, arc, 0, n) for arc, n in enumerate(counts) if n]
    while waiting:
        refused = []
        for at, arc, lo, hi in sorted(waiting):
            s = owners[at]
            take = min(room[s], hi - lo)
            if take:
                out.append((arc, lo, lo + take, s, used[s]))
                room[s] -= take
                used[s] += take
            if lo + take < hi:
                refused.append((at, arc, lo + take, hi))
        waiting = []
        for at, arc, lo, hi in refused:
            nxt = at
            while not room[owners[nxt % arcs]]:
                nxt += 1
            waiting.append((nxt % arcs, arc, lo, hi))
    return out


def shard(
    df: DataFrame, key: str, shards: int = 16, vnodes: int = 64, load_factor: float = 1.0, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Add ``home_shard`` (the ring's choice), ``shard`` and ``slot`` (its place in
    the shard, from 0 without gaps).

    Rows of a cell, about ``cell_rows`` of them at most, are numbered together.  NULL
    keys share one point of the ring; rows of equal key are told apart by the other
    columns, and equal rows are interchangeable.  Columns of the three names in
    ``df`` are replaced, all others stay; an empty frame gives no rows.
    """
    ring = Ring.of(shards, vnodes)
    df = df.drop("home_shard", "shard", "slot")
    pos, at, bucket, arc, cell, rank, base, lo, hi, first_slot = (
        free(df, f"_ring_{c}") for c in ("pos", "at", "bucket", "arc", "cell", "rank", "base", "lo", "hi", "slot")
    )
    splits = [0.0, *(float(p) for p in ring.points if p), float(1 << BITS)]
    first = 1 if ring.points[0] == 0 else 0
    arcs = len(ring.points)

    def on_ring(d: DataFrame) -> DataFrame:
        d = d.withColumn(pos, F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(11)), 64 - BITS))
        d = d.withColumn(at, F.col(pos).cast("double"))
        d = Bucketizer(splits=splits, inputCol=at, outputCol=bucket).transform(d)
        return d.withColumn(arc, (F.col(bucket).cast("int") + first) % arcs).drop(at, bucket)

    per_arc = [0] * arcs
    for k, n in on_ring(df.select(key)).groupBy(arc).count().collect():
        per_arc[k] = n
    rows = sum(per_arc)
    shift = BITS - max(0, (rows // cell_rows).bit_length())

    def in_cells(d: DataFrame) -> DataFrame:
        return on_ring(d).withColumn(cell, F.shiftright(pos, shift))

    placed = [
        (k, a, b, s, ring.owners[k], slot)
        for k, a, b, s, slot in place(per_arc, ring.owners, capacities(rows, shards, load_factor))
    ]
    schema = f"`{arc}` int, `{lo}` long, `{hi}` long, shard int, home_shard int, `{first_slot}` long"
    plan = df.sparkSession.createDataFrame(placed, schema)
    # Rows of the arc that stand in earlier cells: one row per cell.
    earlier = Window.partitionBy(arc).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = in_cells(df.select(key)).groupBy(arc, cell).agg(F.count(F.lit(1)).alias(base))
    cells = cells.withColumn(base, F.coalesce(F.sum(base).over(earlier), F.lit(0)))
    names = df.columns
    order = [pos, *[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]]
    numbered = in_cells(df).withColumn(rank, F.row_number().over(Window.partitionBy(arc, cell).orderBy(*order)) - 1)
    numbered = numbered.join(cells, [arc, cell]).withColumn(rank, F.col(rank) + F.col(base))
    # A row for each arc and each shard it was cut over: some thousands, whatever the table.
    met = numbered.join(F.broadcast(plan), arc).where((F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
    return met.select(*names, "home_shard", "shard", (F.col(first_slot) + F.col(rank) - F.col(lo)).alias("slot"))
