"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    met = both.join(low, "a").where("b > a")
    return met.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(low, "a")
    ties = F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m")))
    return met.select(ties.alias("t")).select(F.col("t.a").alias("a"), F.col("t.m").alias("b")).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that is not the smallest of its component, and that smallest.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; rows with equal
    ends say nothing.  Rounds are written to the shared folder; their number
    grows with the logarithm of the longest chain.  Only counts reach the driver.
    """
    now = stored(edges.where("a != b").select("a", "b").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = mark(now)
    while seen[0]:
        now = stored(_small_star(_large_star(now)), "edges")
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now
