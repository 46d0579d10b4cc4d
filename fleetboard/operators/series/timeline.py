"""Times: distinct, bucketed, filled to a calendar, ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetboard.session import checkpoint

from ..ordered import GROUP_ROWS, attach, in_order, match_keys

STRETCH = 10_000  # steps of a calendar that one row is turned into

UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def distinct_times(points: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Every time of any series, and of ``labels`` if given, once and in order."""
    times = points.select("x")
    if labels is not None:
        times = times.unionByName(labels.select("x"))
    return times.filter(F.col("x").isNotNull()).distinct().orderBy("x")


def time_bucket(ts: Column, unit: str, week_start: int = 1) -> Column:
    """``ts`` rounded down to ``unit``.  Weeks start on ``week_start``, 1 for
    Monday to 7 for Sunday."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    if unit != "week" or week_start == 1:
        return F.date_trunc(unit, ts).cast("timestamp_ntz")
    shift = F.make_interval(days=F.lit(week_start - 1))
    return (F.date_trunc("week", ts - shift) + shift).cast("timestamp_ntz")


def _steps(unit: str, count: Column) -> Column:
    """An interval of ``count`` units."""
    months = {"month": 1, "quarter": 3, "year": 12}
    if unit in months:
        return F.make_interval(months=(count * months[unit]).cast("int"))
    if unit in ("day", "week"):
        return F.make_interval(days=(count * (7 if unit == "week" else 1)).cast("int"))
    return F.make_interval(secs=count * {"hour": 3600, "minute": 60, "second": 1}[unit])


def calendar_spine(
    df: DataFrame,
    ts: str,
    unit: str,
    keys: Sequence[str] = (),
    step: int = 1,
    week_start: int = 1,
    max_steps: int | None = None,
) -> DataFrame:
    """Every ``step`` units from the first time to the last, per key, as ``bucket``.

    The steps are laid out in two levels: stretches of ``STRETCH`` steps first,
    dealt out over the tasks, then the steps of each.  So no row and no task holds
    a whole spine.  With ``max_steps``, more of them in a key are an error.
    """
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    # Without any time there are no ends and no steps.
    ends = ends.filter(F.col("_lo").isNotNull())
    start = time_bucket(F.col("_lo"), unit, week_start)
    count = F.floor(F.timestamp_diff(unit.upper(), start, F.col("_hi")) / step)
    if max_steps is not None:
        many = F.raise_error(F.lit(f"too many {unit} steps between ends"))
        count = F.when(count > max_steps, many.cast("bigint")).otherwise(count)
    spans = ends.select(*keys, start.alias("_lo"), count.alias("_n"))
    stretches = spans.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / STRETCH))).alias("_k"))
    stretches = stretches.repartition(*keys, "_k")
    first = F.col("_k") * STRETCH
    inside = F.sequence(first, F.least(first + (STRETCH - 1), F.col("_n")))
    steps = stretches.select(*keys, "_lo", F.explode(inside).alias("_i"))
    bucket = (F.col("_lo") + _steps(unit, F.col("_i") * step)).cast("timestamp_ntz")
    return steps.select(*keys, bucket.alias("bucket"))


def calendar_fill(
    df: DataFrame,
    ts: str,
    unit: str,
    aggs: dict[str, Column],
    keys: Sequence[str] = (),
    week_start: int = 1,
) -> DataFrame:
    """``aggs`` per key and bucket, with a row of NULLs for an empty bucket."""
    found = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, time_bucket(F.col(ts), unit, week_start).alias("bucket"))
        .agg(*[c.alias(n) for n, c in aggs.items()])
    )
    # The spine's ends come from the buckets found: same result, far fewer rows.
    spine = calendar_spine(found, "bucket", unit, keys, week_start=week_start)
    return match_keys(spine, found, [*keys, "bucket"], "left")


def _ranked(df: DataFrame, keys: Sequence[str], group_rows: int) -> DataFrame:
    """Distinct times with their place ``_i`` and the number ``_n`` of their key's times."""
    times = df.select(*keys, "x").filter(F.col("x").isNotNull())
    return in_order(times, keys, ["x"], group_rows).distinct().number("_i").total("_n").rows()


def time_rank(
    df: DataFrame,
    keys: Sequence[str] = ("series",),
    group_rows: int = GROUP_ROWS,
    ends: tuple | None = None,
) -> DataFrame:
    """Each distinct time i of n at position i / (n - 1); 0 for a single time.

    With ``ends`` (from, to) only times between them count, both included, and a
    key with fewer than two such times has the ends themselves at 0 and 1.
    """
    place = F.coalesce(F.try_divide(F.col("_i").cast("double"), F.col("_n") - 1), F.lit(0.0))
    if ends is None:
        return _ranked(df, keys, group_rows).select(*keys, "x", place.alias("position"))
    kind = df.schema["x"].dataType
    lo, hi = (F.lit(end).cast(kind) for end in ends)
    inside = F.col("x").between(lo, hi)
    many = _ranked(df.filter(inside), keys, group_rows).filter("_n > 1")
    counted = F.when(inside, F.col("x"))
    # Two different times or not: their extremes tell.
    few = df.groupBy(*keys).agg(F.min(counted).alias("_lo"), F.max(counted).alias("_hi"))
    few = few.filter(F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(True)))
    rows = [F.struct(end.alias("x"), F.lit(at).alias("position")) for end, at in ((lo, 0.0), (hi, 1.0))]
    return many.select(*keys, "x", place.alias("position")).unionByName(
        few.select(*keys, F.inline(F.array(*rows)))
    )


def time_positions(
    ranks: DataFrame,
    queries: DataFrame,
    keys: Sequence[str] = ("series",),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Positions of further times: linear between the ranked times around each,
    and on the line through a key's first and last ranked time outside them.  A
    NULL time, and any time of a key without ranks, has the position NULL.

    One ordered pass over both frames put together; no range join.
    """
    known = ranks.select(*keys, "x", "position", F.lit(0).alias("_ask"))
    asked = queries.select(*keys, "x").distinct().withColumns(
        {"position": F.lit(None).cast("double"), "_ask": F.lit(1)}
    )
    here = F.when(F.col("_ask") == 0, F.struct("x", "position"))
    both = in_order(known.unionByName(asked), keys, ["x", "_ask"], group_rows)
    found = both.last_known("_below", here).last_known("_above", here, back=False).rows()
    ends = known.groupBy(*keys).agg(
        F.min("x").alias("_x0"),
        F.max("x").alias("_x1"),
        F.min("position").alias("_p0"),
        F.max("position").alias("_p1"),
    )
    rows = attach(found.filter(F.col("_ask") == 1).drop("position"), ends, keys, how="left")
    outside = F.col("_below").isNull() | F.col("_above").isNull()
    head = F.struct(F.col("_x0").alias("x"), F.col("_p0").alias("position"))
    tail = F.struct(F.col("_x1").alias("x"), F.col("_p1").alias("position"))
    lo = F.when(outside, head).otherwise(F.col("_below"))
    hi = F.when(outside, tail).otherwise(F.col("_above"))
    rows = rows.select(*keys, "x", lo.alias("lo"), hi.alias("hi"))
    part = F.try_divide((F.col("x") - F.col("lo.x")).cast("double"), F.col("hi.x") - F.col("lo.x"))
    rise = F.col("hi.position") - F.col("lo.position")
    position = F.col("lo.position") + F.coalesce(part, F.lit(0.0)) * rise
    return rows.select(*keys, "x", F.when(F.col("x").isNotNull(), position).alias("position"))


def _count(x: Column, kind: T.DataType) -> Column:
    """A place on the axis as a number: seconds of a time, days of a date."""
    if isinstance(kind, T.NumericType):
        return x.cast("double")
    if isinstance(kind, T.DateType):
        return F.datediff(x, F.lit("1970-01-01").cast("date")).cast("double")
    zero = F.lit("1970-01-01 00:00:00").cast(kind)
    return F.timestamp_diff("MICROSECOND", zero, x) / 1e6


def _gaps(sorted_values: Column) -> Column:
    """Differences of neighbours in an array; NULL values none."""
    n = F.size(sorted_values)
    later = F.slice(sorted_values, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(later, F.slice(sorted_values, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)


def smallest_step(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The smallest gap between consecutive distinct x; NULL for a single x.  NULL
    and NaN are no x.

    The closest pair on a line, without putting it in order.  The smallest gap in a
    sample (by a hash of x) of about twice the square root of a key's rows is at
    least the one looked for, and small enough that cells of its width hold a few
    points each.  The closest pair then lies in one cell, or across the border of
    two; so points are grouped by cells of double width, once as they are and once
    moved by half of it, and the smallest gap inside any of them is the answer.
    """
    kind = df.schema["x"].dataType
    points = df.select(*keys, "x", _count(F.col("x"), kind).alias("_at")).filter(F.col("x").isNotNull())
    points = points.filter(~F.isnan("_at"))
    spans = points.groupBy(*keys).agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), F.count("*").alias("_n"))
    spans = checkpoint(spans)
    placed = attach(points, spans, keys)
    share = F.least(F.lit(1.0), F.try_divide(F.lit(2.0), F.sqrt("_n")))
    chosen = placed.filter(F.shiftrightunsigned(F.xxhash64("_at", F.lit(3)), 33) < share * 2**31)
    sampled = chosen.groupBy(*keys).agg(F.sort_array(F.collect_set("_at")).alias("s"))
    widths = sampled.select(*keys, F.array_min(_gaps(F.col("s"))).alias("_w"))
    widths = match_keys(spans, widths, keys, "left") if keys else attach(spans, widths, ())
    # One cell if the sample has no two points; never more cells than a double can tell apart.
    wide = F.greatest(F.coalesce("_w", F.col("_hi") - F.col("_lo") + 1), (F.col("_hi") - F.col("_lo")) / 2**50)
    widths = widths.select(*keys, "_lo", F.when(wide > 0, wide).otherwise(1.0).alias("_w"))
    placed = attach(points, widths, keys)
    moved = [F.struct(F.lit(g).alias("grid"), F.floor((F.col("_at") - F.col("_lo")) / (F.col("_w") * 2) + g / 2).alias("cell")) for g in (0, 1)]
    cells = placed.select(*keys, "x", F.explode(F.array(*moved)).alias("c")).groupBy(*keys, "c.grid", "c.cell")
    inside = cells.agg(F.sort_array(F.collect_set("x")).alias("s"))
    steps = inside.select(*keys, F.array_min(_gaps(F.col("s"))).alias("step"))
    return steps.groupBy(*keys).agg(F.min("step").alias("step"))
