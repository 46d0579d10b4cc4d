"""Runs of a line, slices of it, and whether it is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetboard.session import checkpoint

from ..ordered import BROADCAST_BYTES, BROADCAST_ROWS, GROUP_ROWS, in_order, match_keys


def gap_segments(
    points: DataFrame,
    gap: float | None = None,
    span_gaps: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Points with a value and the 0-based ``segment`` each belongs to.

    A run ends at a NULL value, and where x steps on from the point before by
    more than ``gap``.  With ``span_gaps`` a series is one run across its NULLs.
    """
    y = F.col("y")
    has_value = y.isNotNull() & ~F.isnan(y)
    if span_gaps:
        return points.filter(has_value).withColumn("segment", F.lit(0).cast("bigint"))
    marked = points.withColumn("_has", has_value)
    before = in_order(marked, ["series"], ["x", "id"], group_rows).neighbour(
        {"_px": "x", "_phas": "_has"}
    )
    breaks = ~F.coalesce("_phas", F.lit(False))
    if gap is not None:
        breaks = breaks | F.coalesce(F.col("x") - F.col("_px") > gap, F.lit(False))
    starts = F.when(F.col("_has") & breaks, 1).otherwise(0)
    runs = before.running_sum("segment", starts).rows().filter("_has")
    segment = (F.col("segment") - 1).cast("bigint")
    return runs.withColumn("segment", segment).drop("_px", "_phas", "_has")


REACH = 4  # a search goes this many times as far as the one before it
SEARCHES = 6  # searches of bounded reach; what is not found by then may lie anywhere


def _found(drawn: DataFrame, lo: Column, hi: Column, near: Column, band: Column) -> DataFrame:
    """Per series of the rows in ``band``: the nearest x below and above the range,
    and whether a row is inside."""
    x = F.col("x")
    return drawn.filter(band).groupBy("series").agg(
        F.max(F.when(x < lo, x)).alias("below"), F.min(F.when(x > hi, x)).alias("above"), F.bool_or(near).alias("met")
    )


def _strips(points: DataFrame, lo: Column, hi: Column) -> list[tuple[Column, Column]]:
    """How far each search goes, as long as the axis does; none if the range has no width."""
    ends = []
    for k in range(SEARCHES):
        far = F.try_multiply(F.try_subtract(hi, lo), F.lit(REACH**k))
        ends.append((F.try_subtract(lo, far), F.try_add(hi, far)))
    there = [(hi > lo) & a.isNotNull() & b.isNotNull() for a, b in ends]
    row = points.sparkSession.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(there)]).first()
    return ends[: next((k for k, ok in enumerate(row) if not ok), SEARCHES)]


def range_slice(points: DataFrame, lo, hi, span_gaps: bool = False, series: DataFrame | None = None) -> DataFrame:
    """Points inside [lo, hi] and the nearest one beyond each end, so that a line
    drawn through them reaches both edges.  ``lo`` and ``hi`` are values or
    constant columns of the type of ``x``.

    A point beyond an end counts only if the line goes on from it towards the
    range.  With ``span_gaps`` the line runs across missing values, so a neighbour
    is the nearest point that has one.

    Neighbours are searched outward: as far as the range is wide, then ``REACH``
    times as far, until every series has one on both sides.  Each search reads only
    the strips it adds, and its bounds compare the bare column, so what is read
    follows from the range and its surroundings, not from the length of the history.
    Only after ``SEARCHES`` of them, for series that begin late or end early, is the
    rest of the history looked through.  ``series`` may name those to search for (a
    frame with that column); otherwise they are taken from that column alone of all
    points.  Of points at the same nearest x the one next to the range by ``id`` is
    taken.
    """
    x, y = F.col("x"), F.col("y")
    kind = points.schema["x"].dataType
    lo, hi = ((end if isinstance(end, Column) else F.lit(end)).cast(kind) for end in (lo, hi))
    within = (x >= lo) & (x <= hi)
    drawn = points.filter(y.isNotNull() & ~F.isnan(y)) if span_gaps else points
    named = (drawn if series is None else series).select("series").distinct()
    nothing = F.lit(None).cast(kind)
    none = {"below": nothing, "above": nothing, "met": F.lit(False), "named": F.lit(True)}
    state = named.select("series", *[c.alias(n) for n, c in none.items()])
    strips = _strips(points, lo, hi)
    first, last = lo, hi
    for search in range(len(strips) + 1):
        if search < len(strips):
            low, high = strips[search]
            band = (x >= low) & (x <= high) if not search else (x >= low) & (x < first) | (x > last) & (x <= high)
            first, last = low, high
        else:
            band = (x < first) | (x > last) if search else F.lit(True)
            first = last = None
        more = _found(drawn, lo, hi, within, band).withColumn("named", F.lit(False))
        state = checkpoint(
            state.unionByName(more).groupBy("series").agg(
                F.max("below").alias("below"), F.min("above").alias("above"),
                F.bool_or("met").alias("met"), F.bool_or("named").alias("named"),
            )
        )
        missing = F.count_if(F.col("named") & (F.col("below").isNull() | F.col("above").isNull()))
        size = F.sum(F.octet_length(F.to_json(F.struct(*state.columns))))
        left, rows, bytes_ = state.agg(missing, F.count("*"), size).first()
        if not left:
            break
    small = rows <= BROADCAST_ROWS and (bytes_ or 0) <= BROADCAST_BYTES

    def neighbours(side: str, other: str, reached: Column, pick) -> DataFrame:
        goes_on = F.col("met") | F.col(other).isNotNull()
        wanted = state.filter(F.col(side).isNotNull() & goes_on).select("series", F.col(side).alias("x"))
        tied = match_keys(drawn.filter(reached), F.broadcast(wanted) if small else wanted, ["series", "x"], "inner")
        one = tied.groupBy("series").agg(pick(F.struct(*points.columns), F.col("id")).alias("p"))
        return one.select(*[F.col("p")[c].alias(c) for c in points.columns])

    reached = [(x < lo) if first is None else (x < lo) & (x >= first), (x > hi) if last is None else (x > hi) & (x <= last)]
    before = neighbours("below", "above", reached[0], F.max_by)
    after = neighbours("above", "below", reached[1], F.min_by)
    return points.filter(within).unionByName(before).unionByName(after)


def is_sorted(points: DataFrame, position: str = "id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per series, whether x never falls and is never NULL in ``position`` order."""
    asked = points.select(*dict.fromkeys(["series", "x", position]))
    before = in_order(asked, ["series"], [position], group_rows).neighbour({"_px": "x"}).rows()
    bad = F.col("x").isNull() | F.coalesce(F.col("x") < F.col("_px"), F.lit(False))
    return before.groupBy("series").agg((~F.bool_or(bad)).alias("sorted"))
