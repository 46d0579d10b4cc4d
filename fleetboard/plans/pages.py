"""Dated rows filtered to a range and shown as one or two series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetboard.operators.filters import Day, date_range, date_range_if_both


def metric_by_date(
    df: DataFrame, date: str, metric: str, start: Day = None, end: Day = None
) -> DataFrame:
    """``label`` (the date) and ``value`` of the rows in the range."""
    return date_range(df, date, start, end).select(
        F.col(date).alias("label"), F.col(metric).alias("value")
    )


def two_metrics(
    df: DataFrame,
    date: str,
    metric: str,
    second: str,
    choices: Sequence[str],
    start: Day = None,
    end: Day = None,
) -> DataFrame:
    """``label``, the ``metric`` chosen among ``choices``, and a fixed second one."""
    if metric not in choices:
        raise ValueError(f"unknown metric: {metric}")
    return date_range(df, date, start, end).select(
        F.col(date).alias("label"), F.col(metric).alias("value"), F.col(second).alias("second")
    )


def series_by_position(df: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """A table whose first column is the label and whose next two are series, in
    long form: ``label``, ``series`` (the column's name), ``value``.

    Rows are filtered by the first column when both ends of the range are given.
    """
    label, first, second = df.columns[:3]
    rows = date_range_if_both(df, label, start, end)
    points = [
        F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value"))
        for c in (first, second)
    ]
    return rows.select(F.col(label).alias("label"), F.inline(F.array(*points)))
