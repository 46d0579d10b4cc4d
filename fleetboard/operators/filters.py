"""Date filters.  Every bound is a comparison of the bare column with a literal,
so it reaches the scan and prunes files and row groups."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Day = str | dt.date | None


def as_day(value: Day) -> dt.date | None:
    """A date from an ISO string; missing and empty mean no bound."""
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def _midnight(day: dt.date, dtype: T.DataType) -> Column:
    # The literal takes the column's type; a cast on the column would block pushdown.
    if isinstance(dtype, T.StringType):
        return F.lit(day.isoformat())
    return F.lit(day).cast(dtype)


def all_of(df: DataFrame, clauses: list[Column]) -> DataFrame:
    """Rows that meet every clause; all rows when there is none."""
    return df.filter(reduce(lambda a, b: a & b, clauses)) if clauses else df


def day_clauses(df: DataFrame, column: str, start: Day, end: Day) -> list[Column]:
    """Bounds on whole days, each optional: from the start of ``start`` to the
    last instant of ``end``."""
    dtype = df.schema[column].dataType
    first, last = as_day(start), as_day(end)
    clauses = []
    if first:
        clauses.append(F.col(column) >= _midnight(first, dtype))
    if last:
        clauses.append(F.col(column) < _midnight(last + dt.timedelta(days=1), dtype))
    return clauses


def date_range(df: DataFrame, column: str, start: Day = None, end: Day = None) -> DataFrame:
    return all_of(df, day_clauses(df, column, start, end))


def date_range_if_both(df: DataFrame, column: str, start: Day = None, end: Day = None) -> DataFrame:
    """The range applies only when both ends are given."""
    if as_day(start) and as_day(end):
        return date_range(df, column, start, end)
    return df


def visible(df: DataFrame, label: str, hidden: list[str]) -> DataFrame:
    """Drop hidden series or categories, so they leave totals and extents too.
    A NULL label cannot be hidden."""
    if not hidden:
        return df
    return df.filter(F.col(label).isNull() | ~F.col(label).isin(hidden))
