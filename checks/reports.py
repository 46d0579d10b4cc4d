"""Report queries and their checking SQL.

In the SQL a mean is an exact sum over a count, and a rounded percentage is taken
in whole numbers, so both engines get the same last digit.
"""

from __future__ import annotations

from fleetboard.plans import run, stacked_dashboard
from fleetboard.plans.reports import DASHBOARDS, REAL_TRIP_CHECKS, SIZE_ORDER
from fleetboard.schema import SAFETY_CHECKS, Tables

from .adapter import star, table, with_views

QUERIES = {}
SQL = {}


def _report(name: str, key: str, sql: str | None, dashboard: str = "fleet", **dates: str) -> None:
    QUERIES[name] = lambda spark, folder: run(key, star(spark, folder), dashboard=dashboard, **dates)
    if sql:
        SQL[name] = with_views(sql)


def _between(column: str, start: str | None, end: str | None) -> str:
    parts = []
    if start:
        parts.append(f"cast({column} as date) >= date '{start}'")
    if end:
        parts.append(f"cast({column} as date) <= date '{end}'")
    return " and ".join(parts) or "true"


def _monthly(where: str) -> str:
    return f"""
    select strftime(departure, '%Y-%m') as label, cast(sum(boatamount) as double) as value
    from boattrip where boatamount is not null and {where} group by 1"""


def _passengers(where: str) -> str:
    return f"""
    select cast(cast(departure as date) as varchar) as label,
      cast(coalesce(sum(noofpassengers), 0) as bigint) as value
    from boattrip where {where} group by 1"""


def _by_size(where: str) -> str:
    return f"""
    select b.boatsize as label, coalesce(cast(sum(t.boatamount) as double), 0) as value
    from boattrip t join boat b on b.boatid = t.boatid where {where} group by b.boatsize"""


def _paid(first: str, second: str, where: str = "true") -> str:
    return f"""
    select '{first}' as label, count(*) filter (where ispaid = 1) as value
    from boattrip where {where}
    union all
    select '{second}', count(*) filter (where ispaid = 0 or ispaid is null)
    from boattrip where {where}"""


def _drivers(where: str) -> str:
    return f"""
    select name as label, n as value from (
      select t.driverid, d.firstname || ' ' || d.lastname as name, count(*) as n
      from boattrip t join driver d on d.driverid = t.driverid
      where {where} group by 1, 2 order by n desc, t.driverid limit 10)"""


def _half_up(total: str, n: str) -> str:
    return f"coalesce(cast((2000 * {total} + {n}) // nullif(2 * {n}, 0) as double) / 10, 0)"


def _safety(labels: dict, where: str) -> str:
    return " union all ".join(
        f"select '{text}' as label, {_half_up(f'sum({c})', f'count({c})')} as value"
        f" from boattrip where {where}"
        for c, text in labels.items()
    )


def _boats(where: str, limit: str) -> str:
    return f"""
    select boatno as label, n as value from (
      select t.boatid, b.boatno, count(*) as n
      from boattrip t join boat b on b.boatid = t.boatid
      where {where} group by 1, 2 order by n desc, t.boatid {limit})"""


def _speed_by_size() -> str:
    return """
    select boatsize as label,
      round(cast(sum(iot_speedKnots) as double) / count(iot_speedKnots), 2) as value
    from boat where iot_speedKnots is not null group by boatsize"""


def _duration(where: str) -> str:
    return f"""
    with timed as (
      select cast(departure as date) as day,
        cast(floor(epoch(arrival)) - floor(epoch(departure)) as bigint) as secs
      from boattrip where arrival is not null and departure is not null and {where})
    select cast(day as varchar) as label,
      coalesce(round(cast(sum(secs) as double) / (3600 * count(*)), 2), 0) as value,
      count(*) as trip_count, grouping(day) = 1 as is_total
    from timed where secs > 0 group by grouping sets ((day), ())"""


def _inspections(where: str) -> str:
    return f"""
    select 'User #' || cast(inspectedby as varchar) as label, n as value from (
      select inspectedby, count(*) as n from boattrip where inspectedby <> 0 and {where}
      group by 1 order by n desc, inspectedby limit 15)"""


def _tours(where: str) -> str:
    return f"""
    select islandtourtype as label, coalesce(cast(sum(boatamount) as double), 0) as value
    from boattrip where islandtourtype is not null and islandtourtype <> '' and {where}
    group by 1 order by sum(boatamount) desc nulls last, 1 limit 10"""


def _capacity(where: str) -> str:
    return f"""
    select boatno as label, coalesce(boatcapacity, 0) as capacity,
      coalesce(cast((20 * s + n) // nullif(2 * n, 0) as double) / 10, 0) as avg_passengers
    from (
      select b.boatid, b.boatno, b.boatcapacity, sum(t.noofpassengers) as s,
        count(t.noofpassengers) as n
      from boat b join boattrip t on t.boatid = b.boatid where {where}
      group by 1, 2, 3 order by b.boatcapacity desc nulls last, b.boatid limit 15)"""


AVAILABILITY = """
    select 'Available' as label, count(*) filter (where isavailable = 1) as value from boat
    union all
    select 'Not Available', count(*) filter (where isavailable is distinct from 1) from boat"""

HOURS = """
    select printf('%02d:00', h.h) as label, coalesce(n, 0) as value
    from (select unnest(range(24)) as h) h
    left join (select hour({ts}) as h, count(*) as n from {src} where {ts} is not null group by 1) c
      on c.h = h.h"""

REAL = "status <> '0' and status is not null"

# -- fleet: every report without and, where it takes dates, with a range ---------

H1 = {"start": "1996-01-01", "end": "1996-06-30"}
H1_DEP = _between("departure", *H1.values())



def _both(key: str, sql) -> None:
    """A report over all trips, and over half a year."""
    _report(key, key, sql("true"))
    _report(f"{key}_dated", key, sql(H1_DEP), **H1)


_report("monthly_revenue", "monthly_revenue", _monthly("true"))
_report("monthly_revenue_dated", "monthly_revenue", _monthly(H1_DEP), **H1)
_report("passenger_trends", "passenger_trends", _passengers("true"))
_report(
    "passenger_trends_from",
    "passenger_trends",
    _passengers(_between("departure", "1999-07-01", None)),
    start="1999-07-01",
)
_report("revenue_by_boat_size", "revenue_by_boat_size", _by_size("true"))
_report("revenue_by_boat_size_dated", "revenue_by_boat_size", _by_size(H1_DEP), **H1)
_report("paid_unpaid", "paid_unpaid", _paid("Paid", "Unpaid / Pending"))
_report(
    "paid_unpaid_until",
    "paid_unpaid",
    _paid("Paid", "Unpaid / Pending", _between("departure", None, "1996-06-30")),
    end="1996-06-30",
)
_report("top_drivers", "top_drivers", _drivers("true"))
_report("top_drivers_dated", "top_drivers", _drivers(H1_DEP), **H1)
_report("cancelled_by_driver", "cancelled_by_driver", _drivers("datecancelled is not null"))
_report(
    "cancelled_by_driver_dated",
    "cancelled_by_driver",
    _drivers(_between("datecancelled", *H1.values())),
    **H1,
)
_report("safety_compliance", "safety_compliance", _safety(SAFETY_CHECKS, "true"))
_report("safety_compliance_dated", "safety_compliance", _safety(SAFETY_CHECKS, H1_DEP), **H1)
_both("inspections_by_personnel", _inspections)
_report(
    "avg_speed_per_boat",
    "avg_speed_per_boat",
    """
    select boatno as label, m as value from (
      select boatid, boatno, cast(sum(iot_speedKnots) as double) / count(iot_speedKnots) as m
      from boat where iot_speedKnots is not null
      group by 1, 2 order by m desc, boatid limit 15)""",
)
_both("revenue_by_tour_type", _tours)
_both("capacity_vs_passengers", _capacity)
_both("payment_completion", lambda where: _paid("Completed", "Outstanding", where))
_report("avg_speed_by_size", "avg_speed_by_size", _speed_by_size())
_both("peak_hours", lambda where: HOURS.format(ts="departure", src=f"(select * from boattrip where {where})"))
_report("monthly_revenue_blank", "monthly_revenue", _monthly("true"), start="", end="")

# -- activity --------------------------------------------------------------------

_report("trips_per_boat", "trips_per_boat", _boats("true", ""), "activity")
_report("trips_per_boat_dated", "trips_per_boat", _boats(H1_DEP, ""), "activity", **H1)
_report("boat_availability", "boat_availability", AVAILABILITY, "activity")
_report(
    "boat_size",
    "boat_size",
    "select coalesce(boatsize, 'Unknown') as label, count(*) as value from boat group by boatsize",
    "activity",
)
_report("trip_duration", "trip_duration", _duration("true"), "activity")
_report("trip_duration_dated", "trip_duration", _duration(H1_DEP), "activity", **H1)

# -- overview: no dates ------------------------------------------------------------

_report("trips_per_boat_top10", "trips_per_boat", _boats("t.boatid <> 0", "limit 10"), "overview")
_report(
    "monthly_revenue_overview", "monthly_revenue", _monthly("departure is not null"), "overview"
)
_report("revenue_by_size_fixed", "revenue_by_size", _by_size("t.boatamount is not null"), "overview")
_report("paid_unpaid_overview", "paid_unpaid", _paid("Paid", "Unpaid / Pending"), "overview")
_report("boat_availability_overview", "boat_availability", AVAILABILITY, "overview")
_report(
    "boat_size_distribution",
    "boat_size_distribution",
    "select boatsize as label, count(*) as value from boat group by boatsize",
    "overview",
)
_report(
    "top_drivers_real", "top_drivers", _drivers(f"t.driverid <> 1 and {REAL}"), "overview"
)
_report(
    "trips_by_status",
    "trips_by_status",
    f"""
    select coalesce(nullif(t.status, ''), 'Unknown') as label, count(*) as value
    from boattrip t where {REAL} group by t.status""",
    "overview",
)
_report("avg_speed_by_size_fixed", "avg_speed_by_size", _speed_by_size(), "overview")
_report("safety_compliance_real", "safety_compliance", _safety(REAL_TRIP_CHECKS, REAL), "overview")


# -- the same report over event times, which fall in every hour ---------------------


def peak_hours_events(spark, folder):
    events = table(spark, folder, "events").withColumnRenamed("ts", "departure")
    tables = star(spark, folder)
    return run("peak_hours", Tables(events, tables.boat, tables.driver))


QUERIES["peak_hours_events"] = peak_hours_events
SQL["peak_hours_events"] = HOURS.format(ts="ts", src="events")


# -- sizes in their fixed order, with the place of each -----------------------------


def size_order(spark, folder):
    from pyspark.sql import functions as F

    from fleetboard.functions import value_order

    sizes = run("boat_size_distribution", star(spark, folder), dashboard="overview")
    return sizes.withColumn("place", value_order(F.col("label"), SIZE_ORDER).cast("int"))


QUERIES["size_order"] = size_order
SQL["size_order"] = with_views("""
    select boatsize as label, count(*) as value,
      cast(case boatsize when 'Small' then 1 when 'Medium' then 2 when 'Large' then 3 else 0 end
        as int) as place
    from boat group by boatsize""")


# -- SQL text with bound values ------------------------------------------------------


def bound_named(spark, folder):
    return star(spark, folder).sql(
        "select islandtourtype as label, count(*) as value from {trip}"
        " where departure >= :start and boatamount >= :least group by islandtourtype",
        {"start": "1996-01-01", "least": 1000},
    )


def bound_positional(spark, folder):
    return star(spark, folder).sql(
        "select boatsize as label, count(*) as value from {boat}"
        " where boatcapacity >= ? and boatcapacity <= ? group by boatsize",
        [10, 40],
    )


QUERIES["bound_named"] = bound_named
SQL["bound_named"] = with_views("""
    select islandtourtype as label, count(*) as value from boattrip
    where departure >= timestamp '1996-01-01' and boatamount >= 1000 group by 1""")
QUERIES["bound_positional"] = bound_positional
SQL["bound_positional"] = with_views("""
    select boatsize as label, count(*) as value from boat
    where boatcapacity between 10 and 40 group by 1""")


# -- whole dashboards in one frame ----------------------------------------------------


def _stacked(name: str, dashboard: str, found: dict[str, str], **dates: str) -> None:
    """``found``: report to the query that holds its SQL."""
    QUERIES[name] = lambda spark, folder: stacked_dashboard(
        dashboard, star(spark, folder), **dates
    )
    selects = []
    for key, report in DASHBOARDS[dashboard].items():
        names = {column: series or key for column, (series, _) in report.series.items()}
        names |= {column: column for column in report.extra if column != "is_total"}
        total = "is_total" if "is_total" in report.extra else "false"
        selects += [
            f"select '{key}' as report, '{series}' as series, cast(label as varchar) as label,"
            f" cast({column} as double) as value, {total} as is_total"
            f" from ({SQL[found.get(key, key)]})"
            for column, series in names.items()
        ]
    SQL[name] = " union all ".join(selects)


_stacked(
    "dashboard_overview",
    "overview",
    {
        "trips_per_boat": "trips_per_boat_top10",
        "monthly_revenue": "monthly_revenue_overview",
        "revenue_by_size": "revenue_by_size_fixed",
        "paid_unpaid": "paid_unpaid_overview",
        "boat_availability": "boat_availability_overview",
        "top_drivers": "top_drivers_real",
        "avg_speed_by_size": "avg_speed_by_size_fixed",
        "safety_compliance": "safety_compliance_real",
    },
)
_stacked("dashboard_activity", "activity", {})
_stacked("dashboard_fleet", "fleet", {})

# Under one filter; reports over boats alone have no dates.
_report("passenger_trends_dated", "passenger_trends", _passengers(H1_DEP), **H1)
_report("paid_unpaid_dated", "paid_unpaid", _paid("Paid", "Unpaid / Pending", H1_DEP), **H1)
for _dashboard in ("activity", "fleet"):
    _dated = {key: f"{key}_dated" for key in DASHBOARDS[_dashboard] if f"{key}_dated" in SQL}
    _stacked(f"dashboard_{_dashboard}_dated", _dashboard, _dated, **H1)
