"""Axis extents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf"))


def _double(value: float | None) -> Column:
    return F.lit(value).cast("double")


def extents(
    points: DataFrame,
    axis: str = "y",
    keys: Sequence[str] = ("series",),
    other: tuple[float | None, float | None] = (None, None),
    user: tuple[float | None, float | None] = (None, None),
    suggested: tuple[float | None, float | None] = (None, None),
    hidden: Sequence[str] = (),
) -> DataFrame:
    """``lo`` and ``hi`` of one axis per key, a row for every key that is visible.

    Counted are visible points with a finite value whose other axis lies inside
    ``other``.  ``user`` bounds win over the data, ``suggested`` ones only widen
    it.  With no point and no bound both ends are NULL; one known end stands for
    the other.  For stacked series pass the frame of :func:`stack_series` with
    ``axis="top"``.
    """
    across = F.col("x" if axis != "x" else "y")
    if hidden:
        points = points.filter(F.col("series").isNull() | ~F.col("series").isin(list(hidden)))
    value = F.col(axis).cast("double")
    counted = _finite(value)
    if other[0] is not None:
        counted = counted & (across >= other[0])
    if other[1] is not None:
        counted = counted & (across <= other[1])
    # Conditional, so that a key without a counted point keeps its row.
    data = F.when(counted, value)
    per_key = points.groupBy(*keys).agg(
        F.least(F.min(data), _double(suggested[0])).alias("data_lo"),
        F.greatest(F.max(data), _double(suggested[1])).alias("data_hi"),
    )
    forced_lo, forced_hi = _double(user[0]), _double(user[1])
    # An end set by the user beyond the other one pulls that along.
    lo = F.least("data_lo" if user[0] is None else forced_lo, forced_hi)
    hi = F.greatest("data_hi", forced_lo) if user[1] is None else forced_hi
    return per_key.select(*keys, F.coalesce(lo, hi).alias("lo"), F.coalesce(hi, lo).alias("hi"))


def adjust_extents(
    df: DataFrame,
    begin_at_zero: bool = False,
    grace: float | str | None = None,
    user: tuple[float | None, float | None] = (None, None),
) -> DataFrame:
    """The range to show for ``lo`` and ``hi``.

    No data gives 0 to 1.  ``begin_at_zero`` moves the end nearer to zero onto
    it.  Equal ends move apart by 5 percent of the value (by 1 for zero), the
    lower one only without ``begin_at_zero``.  ``grace`` then adds a number, or a
    percentage of half the range, at both ends, but leaves an end at zero under
    ``begin_at_zero``.  Ends set by the user stay, except under grace.
    """
    # Each step is a pair of columns, worked out for both ends at once; ``free``
    # says which of them the rules may move.
    free = {"lo": user[0] is None, "hi": user[1] is None}
    rest = [c for c in df.columns if c not in free]
    shown = df.select(*rest, F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))
    zero = F.lit(0.0)
    above, below = F.least("lo", "hi") > 0, F.greatest("lo", "hi") < 0
    anchored = {
        "lo": F.when(above & F.lit(begin_at_zero and free["lo"]), zero).otherwise(F.col("lo")),
        "hi": F.when(below & F.lit(begin_at_zero and free["hi"]), zero).otherwise(F.col("hi")),
    }
    shown = shown.select(*rest, *[end.alias(name) for name, end in anchored.items()])
    flat = F.col("lo") == F.col("hi")
    gap = F.when(F.col("hi") == 0, 1.0).otherwise(F.abs("hi") * 0.05)
    pad = {
        "lo": F.when(flat & F.lit(free["lo"] and not begin_at_zero), gap).otherwise(zero),
        "hi": F.when(flat & F.lit(free["hi"]), gap).otherwise(zero),
    }
    shown = shown.select(*rest, (F.col("lo") - pad["lo"]).alias("lo"), (F.col("hi") + pad["hi"]).alias("hi"))
    if grace is None:
        return shown.select(*df.columns)
    percent = isinstance(grace, str) and grace.endswith("%")
    share = float(str(grace).rstrip("%"))
    more = F.abs((F.col("hi") - F.col("lo")) / 2 * (share / 100)) if percent else F.lit(abs(share))
    room = {name: F.when((F.col(name) == 0) & F.lit(begin_at_zero), zero).otherwise(more) for name in free}
    shown = shown.select(*rest, (F.col("lo") - room["lo"]).alias("lo"), (F.col("hi") + room["hi"]).alias("hi"))
    return shown.select(*df.columns)
