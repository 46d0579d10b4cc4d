"""A report as records for a page: one header, then one record per point.

The shape is the same for every report and every size: no array ever holds a
report's points, so no row or task grows with it.  :func:`payload_json` writes the
records as JSON lines; :func:`payload_text` as the lines of the one JSON object a
chart page reads.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetboard.operators.filters import Day
from fleetboard.operators.ordered import GROUP_ROWS, in_order
from fleetboard.schema import Tables
from fleetboard.session import checkpoint

from .reports import Report, find

HEADER = -1  # place of the header; points count from 0


def _shown(report: Report, dashboard: str) -> list[tuple[str | None, str | None]]:
    """Name and chart type of each series; only the fleet dashboard has them."""
    return list(report.series.values()) if dashboard == "fleet" else [(None, None)]


def _values(report: Report, dashboard: str) -> Column:
    if dashboard != "fleet":
        return F.array("value")
    return F.array(*[F.col(c).cast("double") for c in report.series])


def payload(
    key: str,
    tables: Tables,
    start: Day = None,
    end: Day = None,
    dashboard: str = "fleet",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The records of a report by ``place``: the header at ``HEADER``, then the
    points from 0 in the report's order.

    The header has ``points`` (how many follow), ``series`` (name and type of each)
    and, for trip duration, ``overall_avg`` and ``trip_count``.  A point has its
    ``label`` and one entry of ``values`` per series.  What a record does not have
    is NULL.  An empty report is a header alone.
    """
    report = find(key, dashboard)
    # The report is small next to the trips but is used twice below (counted, then
    # numbered), so it is computed once.
    result = checkpoint(report.limited(tables, start, end))
    totals = "is_total" in report.extra
    rows = result.filter(~F.col("is_total")) if totals else result
    overall, trips = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    # One row by construction, so either aggregate is that row's value.
    of_total = [F.max_by(c, "is_total") for c in ("value", "trip_count")] if totals else [overall, trips]
    shown = [
        F.struct(F.lit(n).cast("string").alias("label"), F.lit(t).cast("string").alias("type"))
        for n, t in _shown(report, dashboard)
    ]
    is_point = F.lit(True) if not totals else ~F.col("is_total")
    head = result.agg(
        F.count_if(is_point).alias("points"),
        of_total[0].cast("double").alias("overall_avg"),
        of_total[1].cast("bigint").alias("trip_count"),
    ).select(F.lit(HEADER).cast("bigint").alias("place"), F.array(*shown).alias("series"), "*")
    keys = {f"_key{i}": c for i, c in enumerate(report.order(ascending=True))}
    points = in_order(rows.withColumns(keys), [], list(keys), group_rows).number("place").rows()
    points = points.select("place", F.col("label").cast("string").alias("label"), _values(report, dashboard).alias("values"))
    return head.unionByName(points, allowMissingColumns=True).select(
        "place", "points", "series", "overall_avg", "trip_count", "label", "values"
    )


def payload_json(df: DataFrame) -> DataFrame:
    """The records of :func:`payload` as JSON, one line each, by ``place``."""
    keep_nulls = {"ignoreNullFields": "false"}
    header = F.to_json(F.struct("points", "series", "overall_avg", "trip_count"), keep_nulls)
    point = F.to_json(F.struct("label", "values"), keep_nulls)
    return df.select("place", F.when(F.col("place") == HEADER, header).otherwise(point).alias("json"))


def _scalar(value: Column) -> Column:
    """JSON text of a single value, ``null`` for NULL."""
    text = F.to_json(F.array(value))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def payload_text(
    key: str, tables: Tables, start: Day = None, end: Day = None, dashboard: str = "fleet"
) -> DataFrame:
    """``text`` lines in order which, one after the other, are the JSON object of a
    report: ``labels`` and ``datasets`` (label, type, data), or ``labels`` and
    ``data``, to which trip duration adds ``overall_avg`` and ``trip_count``.

    Written with ``write.text`` the files in the order of their names are the
    object, at any size.
    """
    report = find(key, dashboard)
    # Numbered once, then laid out once for the labels and once per series.
    records = checkpoint(payload(key, tables, start, end, dashboard))
    points, head = records.filter(F.col("place") != HEADER), records.filter(F.col("place") == HEADER)
    comma = F.when(F.col("place") == 0, "").otherwise(",")

    def fixed(section: int, text: Column | str) -> DataFrame:
        line = F.lit(text) if isinstance(text, str) else text
        return head.select(F.lit(section).alias("section"), "place", line.alias("text"))

    def listed(section: int, value: Column) -> DataFrame:
        return points.select(F.lit(section).alias("section"), "place", F.concat(comma, _scalar(value)).alias("text"))

    fleet = dashboard == "fleet"
    parts = [fixed(0, '{"labels":['), listed(0, F.col("label"))]
    for i, (name, kind) in enumerate(_shown(report, dashboard)):
        named = "{" + f'"label":{json.dumps(name)},"type":{json.dumps(kind)},"data":['
        opened = ("]," + '"datasets":[' if i == 0 else "]},") + named if fleet else '],"data":['
        parts += [fixed(i + 1, opened), listed(i + 1, F.col("values")[i])]
    end_at = len(parts) // 2
    if "is_total" in report.extra:
        scalars = [F.concat(F.lit(f',"{c}":'), _scalar(F.col(c))) for c in ("overall_avg", "trip_count")]
        close = F.concat(F.lit("]}]" if fleet else "]"), *scalars, F.lit("}"))
    else:
        close = F.lit("]}]}" if fleet else "]}")
    parts.append(fixed(end_at, close))
    return reduce(DataFrame.unionByName, parts).orderBy("section", "place").select("text")
