"""Stacked values and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordered import GROUP_ROWS, attach, in_order, match_keys


def stack_series(
    points: DataFrame, group_rows: int = GROUP_ROWS, single: bool = False
) -> DataFrame:
    """``base`` and ``top`` of every point stacked on the earlier series at its x.

    Needs ``stack``, ``series``, ``series_order``, ``x``, ``y``, ``id``.  Inside a
    stack, values at one x pile up in series order, positive ones upwards and
    negative ones downwards; with ``single`` all on one pile, whatever their
    sign.  A zero has no height and sits on the pile of the first non-zero value
    below it.  Every point with a value comes out; of several points of one series
    at the same x the last one by ``id`` is what later series stand on, and a
    last one without a value is nothing to stand on.
    """
    place = ["stack", "x", "series", "series_order"]
    last = points.groupBy(*place).agg(F.max_by("y", "id").alias("_y"))
    # At one x a stack has at most one value per series.
    widest = (
        points.groupBy("stack")
        .agg(F.countDistinct("series", "series_order").alias("n"))
        .agg(F.max("n"))
        .first()[0]
    )
    own = F.col("_y")
    piled = (
        in_order(last, ["stack", "x"], ["series_order", "series"], group_rows, widest or 0)
        .running_sum("_up", F.when(own > 0, own))
        .running_sum("_down", F.when(own < 0, own))
        .running_sum("_some", F.when(own != 0, F.lit(1)))
        .first_known("_sign", F.when(own != 0, F.signum(own)))
        .rows()
    )
    rows = match_keys(points.filter(F.col("y").isNotNull()), piled, place, "inner")
    y, zero = F.col("y"), F.lit(0.0)
    up, down = F.coalesce("_up", zero), F.coalesce("_down", zero)
    # What lies below: the running sums without the series' own last value, and the
    # sign of the first value only if that is an earlier one.
    under_up = up - F.coalesce(F.when(own > 0, own), zero)
    under_down = down - F.coalesce(F.when(own < 0, own), zero)
    earlier = F.coalesce("_some", F.lit(0)) > F.coalesce(F.when(own != 0, 1).otherwise(0), F.lit(0))
    side = F.when(y != 0, F.signum(y)).when(earlier, F.col("_sign"))
    apart = (
        F.when((y > 0) & (y == own), up)
        .when((y < 0) & (y == own), down)
        .when(side > 0, under_up + y)
        .when(side < 0, under_down + y)
        .otherwise(zero)
    )
    top = under_up + under_down + y if single else apart
    return rows.select(*place, "id", "y", (top - y).alias("base"), top.alias("top"))


def share_of_total(points: DataFrame, hidden: list[str] | None = None) -> DataFrame:
    """Each value's part of its series by absolute size; 0 where the total is 0.

    ``hidden`` labels (column ``label``) leave both rows and totals.
    """
    if hidden:
        points = points.filter(F.col("label").isNull() | ~F.col("label").isin(hidden))
    size = F.abs("y")
    totals = points.groupBy("series").agg(F.coalesce(F.sum(size), F.lit(0.0)).alias("_total"))
    share = F.when(F.col("_total") > 0, F.coalesce(size / F.col("_total"), F.lit(0.0)))
    rows = attach(points, totals, ["series"])
    return rows.withColumn("share", F.coalesce(share, F.lit(0.0))).drop("_total")
