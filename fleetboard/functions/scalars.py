"""Column expressions shared by the reports.  All are built-in functions, so they
stay inside generated code and can be pushed or folded by the optimizer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_label(ts: Column) -> Column:
    """``2026-01`` for any time in January 2026; NULL stays NULL."""
    return F.date_format(ts, "yyyy-MM")


def hour_label(hour: Column) -> Column:
    """``07:00`` for 7."""
    return F.format_string("%02d:00", hour)


def full_name(first: Column, last: Column) -> Column:
    """First and last name with a space; NULL if either is NULL."""
    return F.concat(first, F.lit(" "), last)


def null_if_blank(col: Column, default: str) -> Column:
    """The text, or ``default`` when it is empty or NULL."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def value_order(col: Column, values: Sequence[str]) -> Column:
    """1-based place of ``col`` in ``values``; 0 for NULL and for anything else,
    so those sort first."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), col), F.lit(0))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, whatever the session's time zone."""
    return F.timestamp_diff("SECOND", start, end)


def ratio(total: Column, n: Column) -> Column:
    """``total / n`` as double, NULL for no rows.

    Means are taken as an exact sum over a count, so a mean does not depend on
    the order in which partitions were added up.
    """
    return F.try_divide(total.cast("double"), n.cast("double"))


def percent(total: Column, n: Column, digits: int = 1) -> Column:
    """Share of ``n`` in percent, rounded half up; 0 for no rows."""
    return F.coalesce(F.round(ratio(total * 100, n), digits), F.lit(0.0))
