"""Every report of a dashboard under one date filter."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetboard.operators.filters import Day, day_clauses
from fleetboard.schema import Tables

from .reports import DASHBOARDS
from .shared import kept, limited_reports


def _limited(dashboard: str, tables: Tables, start: Day, end: Day, shared: bool) -> dict[str, DataFrame]:
    if dashboard not in DASHBOARDS:
        raise ValueError(f"unknown dashboard: {dashboard}")
    if shared:
        return limited_reports(dashboard, tables, start, end)
    return {key: report.limited(tables, start, end) for key, report in DASHBOARDS[dashboard].items()}


def run_dashboard(
    dashboard: str, tables: Tables, start: Day = None, end: Day = None, shared: bool = True
) -> dict[str, DataFrame]:
    """All reports of a dashboard by key.  With ``shared`` the trips are read once
    for every grain (see :mod:`.shared`), now; else by each report when it is used."""
    rows = _limited(dashboard, tables, start, end, shared)
    return {key: DASHBOARDS[dashboard][key].shown(df) for key, df in rows.items()}


@contextmanager
def open_dashboard(
    dashboard: str,
    tables: Tables,
    start: Day = None,
    end: Day = None,
    persist: bool | None = None,
) -> Iterator[dict[str, DataFrame]]:
    """:func:`run_dashboard` for as long as it is open.

    By default reports share summaries of the trips.  With ``persist`` the trips of
    the range themselves are kept for all reports, which is for reports beyond the
    registered ones: kept are trips that departed or were cancelled in the range,
    and each report still applies its own filter.  With ``persist=False`` every
    report reads the two or three columns it needs from the files.
    """
    if dashboard not in DASHBOARDS:
        raise ValueError(f"unknown dashboard: {dashboard}")
    if not persist:
        yield run_dashboard(dashboard, tables, start, end, shared=persist is None)
        return
    trip = tables.trip
    dated = all(report.dated for report in DASHBOARDS[dashboard].values())
    bounds = [day_clauses(trip, c, start, end) for c in ("departure", "datecancelled")]
    if dated and all(bounds):
        either = [reduce(and_, clauses) for clauses in bounds]
        trip = trip.filter(either[0] | either[1])
    with kept(trip) as stored:
        yield run_dashboard(dashboard, Tables(stored, tables.boat, tables.driver), start, end, shared=False)


def stacked_dashboard(
    dashboard: str, tables: Tables, start: Day = None, end: Day = None, shared: bool = True
) -> DataFrame:
    """All reports of a dashboard in one long frame: report, series, label, value
    and ``is_total``, which marks a total over all labels.

    Counts that a report gives besides its series are series of their own name.
    With ``shared`` the trips are read once for every grain, else once for every report.
    """
    parts = []
    for key, frame in _limited(dashboard, tables, start, end, shared).items():
        report = DASHBOARDS[dashboard][key]
        names = {column: name or key for column, (name, _) in report.series.items()}
        names |= {column: column for column in report.extra if column != "is_total"}
        total = F.col("is_total") if "is_total" in report.extra else F.lit(False)
        for column, name in names.items():
            parts.append(
                frame.select(
                    F.lit(key).alias("report"),
                    F.lit(name).alias("series"),
                    F.col("label").cast("string").alias("label"),
                    F.col(column).cast("double").alias("value"),
                    total.alias("is_total"),
                )
            )
    return reduce(DataFrame.unionByName, parts)
