"""The named reports.

A report is built as a frame with its sort keys still in it; :func:`run` orders
it, takes the first rows where the report has a limit, and keeps label and value
columns.  Reports that differ only by a filter, a limit or an order share one
builder with parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetboard.functions import (
    full_name,
    hour_label,
    month_label,
    null_if_blank,
    ratio,
    seconds_between,
    value_order,
)
from fleetboard.operators import relational as rel
from fleetboard.operators.filters import Day, date_range
from fleetboard.schema import SAFETY_CHECKS, Tables

# Fixed values.
SIZE_ORDER = ("Small", "Medium", "Large")
PAID_LABELS = ("Paid", "Unpaid / Pending")
COMPLETION_LABELS = ("Completed", "Outstanding")
AVAILABILITY_LABELS = ("Available", "Not Available")
REAL_TRIP_CHECKS = {
    "checklifevest": "Life Vest",
    "checklifevestchildren": "Child Vest",
    "checkfireextandsand": "Fire Ext",
    "checktrashbin": "Trash Bin",
    "checkgas": "Gas",
    "checkhelper": "Helper",
}
SEED_STATUS = "0"
PLACEHOLDER_DRIVER = 1
UNKNOWN = "Unknown"


@dataclass(frozen=True)
class Report:
    """``series`` gives each value column its shown name and chart type.  A report
    that is not ``dated`` always covers all trips."""

    build: Callable[[Tables, Day, Day], DataFrame]
    order: Callable[..., list[Column]]
    series: dict[str, tuple[str | None, str | None]] = field(
        default_factory=lambda: {"value": (None, None)}
    )
    limit: int | None = None
    extra: tuple[str, ...] = ()
    dated: bool = True

    @property
    def columns(self) -> list[str]:
        return ["label", *self.series, *self.extra]

    def limited(self, tables: Tables, start: Day = None, end: Day = None) -> DataFrame:
        """The report's rows with its sort keys, sorted only where a limit needs it."""
        rows = self.build(tables, start, end) if self.dated else self.build(tables, None, None)
        return self.cut(rows)

    def cut(self, rows: DataFrame) -> DataFrame:
        """The first of the built rows, in order, if the report has a limit; else all, as they are."""
        return rows if self.limit is None else rel.top_k(rows, self.order(), self.limit)

    def shown(self, limited: DataFrame) -> DataFrame:
        """Label and value columns in report order."""
        rows = limited if self.limit is not None else limited.orderBy(*self.order())
        return rows.select(*self.columns)


def _by(*columns: str) -> Callable[[bool], list[Column]]:
    """Sort keys from names; ``-name`` is descending with NULL last.  With
    ``ascending`` the keys are values that give this order when they rise."""

    def key(c: str, ascending: bool) -> Column:
        if not c.startswith("-"):
            return F.col(c)
        if not ascending:
            return F.desc_nulls_last(c[1:])
        return F.struct(F.col(c[1:]).isNull().alias("none"), (-F.col(c[1:])).alias("less"))

    return lambda ascending=False: [key(c, ascending) for c in columns]


def _in_order(labels: Sequence[str], column: str = "label") -> Callable[[bool], list[Column]]:
    return lambda ascending=False: [value_order(F.col(column), labels), F.col(column)]


def _money(total: str) -> Column:
    """Exact decimal total shown as a double, 0 when every amount was NULL."""
    return F.coalesce(F.col(total).cast("double"), F.lit(0.0))


# -- revenue -----------------------------------------------------------------


def monthly_revenue(t: Tables, start: Day, end: Day, dated_only: bool = False) -> DataFrame:
    """Amount per departure month.  Trips without a departure form a NULL month
    unless ``dated_only``."""
    trips = date_range(t.trip, "departure", start, end).filter(F.col("boatamount").isNotNull())
    if dated_only:
        trips = trips.filter(F.col("departure").isNotNull())
    # Grouped by a date, which is an int inside; the text is made once per month.
    month = F.trunc(F.to_date("departure"), "MM").alias("month")
    totals = rel.sum_exact(trips, [month], "boatamount", "total")
    return totals.select(month_label(F.col("month")).alias("label"), _money("total").alias("value"))


def revenue_by_size(t: Tables, start: Day, end: Day, known_only: bool = False) -> DataFrame:
    """Amount per boat size.  With ``known_only`` a size counts only if it has a
    trip with an amount; otherwise a size without amounts shows 0."""
    trips = date_range(t.trip, "departure", start, end)
    if known_only:
        trips = trips.filter(F.col("boatamount").isNotNull())
    per_boat = rel.sum_exact(trips, ["boatid"], "boatamount", "amount")
    return size_totals(rel.with_dimension(per_boat, t.boat, "boatid", "boatsize"))


def size_totals(sized: DataFrame) -> DataFrame:
    """Amounts per boat, with its size, added up by size."""
    totals = sized.groupBy(F.col("boatsize").alias("label")).agg(F.sum("amount").alias("total"))
    return totals.withColumn("value", _money("total"))


def revenue_by_tour_type(t: Tables, start: Day, end: Day) -> DataFrame:
    trips = date_range(t.trip, "departure", start, end).filter(F.col("islandtourtype") != "")
    kind = F.col("islandtourtype").alias("label")
    totals = rel.sum_exact(trips, [kind], "boatamount", "total")
    return totals.withColumn("value", _money("total"))


# -- counts ------------------------------------------------------------------


def passenger_trends(t: Tables, start: Day, end: Day) -> DataFrame:
    trips = date_range(t.trip, "departure", start, end)
    days = trips.groupBy(F.to_date("departure").alias("day")).agg(
        F.coalesce(F.sum("noofpassengers"), F.lit(0)).cast("bigint").alias("value")
    )
    return days.select(F.col("day").cast("string").alias("label"), "value")


def payment_counts(t: Tables, start: Day, end: Day, labels: tuple[str, str]) -> DataFrame:
    """Trips paid (1), and trips open (0 or NULL); other codes are in neither."""
    paid = F.col("ispaid")
    return rel.conditional_counts(
        date_range(t.trip, "departure", start, end),
        {labels[0]: paid == 1, labels[1]: (paid == 0) | paid.isNull()},
    )


def trips_per_driver(
    t: Tables,
    start: Day,
    end: Day,
    cancelled_only: bool = False,
    real_only: bool = False,
) -> DataFrame:
    """Trips per driver.  ``cancelled_only`` counts by the day of cancellation;
    ``real_only`` leaves out the placeholder driver and trips whose status is the
    seed status or NULL."""
    trips = date_range(t.trip, "datecancelled" if cancelled_only else "departure", start, end)
    trips = trips.filter(F.col("driverid").isNotNull())
    if cancelled_only:
        trips = trips.filter(F.col("datecancelled").isNotNull())
    if real_only:
        trips = trips.filter(
            (F.col("driverid") != PLACEHOLDER_DRIVER) & (F.col("status") != SEED_STATUS)
        )
    return named_drivers(t, rel.per_key(trips, "driverid", F.count("*").alias("value")))


def named_drivers(t: Tables, counts: DataFrame) -> DataFrame:
    named = rel.with_dimension(counts, t.driver, "driverid", "firstname", "lastname")
    return named.select(
        "driverid", full_name(F.col("firstname"), F.col("lastname")).alias("label"), "value"
    )


def trips_per_boat(t: Tables, start: Day, end: Day, real_only: bool = False) -> DataFrame:
    trips = date_range(t.trip, "departure", start, end)
    if real_only:
        trips = trips.filter(F.col("boatid") != 0)
    return named_boats(t, rel.per_key(trips, "boatid", F.count("*").alias("value")))


def named_boats(t: Tables, counts: DataFrame) -> DataFrame:
    named = rel.with_dimension(counts, t.boat, "boatid", "boatno")
    return named.select("boatid", F.col("boatno").alias("label"), "value")


def inspections(t: Tables, start: Day, end: Day) -> DataFrame:
    trips = date_range(t.trip, "departure", start, end).filter(F.col("inspectedby") != 0)
    return named_inspectors(rel.per_key(trips, "inspectedby", F.count("*").alias("value")))


def named_inspectors(counts: DataFrame) -> DataFrame:
    label = F.concat(F.lit("User #"), F.col("inspectedby").cast("string")).alias("label")
    return counts.select("inspectedby", label, "value")


def trips_by_status(t: Tables, start: Day, end: Day) -> DataFrame:
    """Grouped by the stored status and named afterwards, so a stored 'Unknown'
    and an empty status stay two rows."""
    counts = rel.per_key(
        t.trip.filter(F.col("status") != SEED_STATUS), "status", F.count("*").alias("value")
    )
    return counts.withColumn("label", null_if_blank(F.col("status"), UNKNOWN))


def peak_hours(t: Tables, start: Day, end: Day) -> DataFrame:
    hours = rel.hourly_counts(date_range(t.trip, "departure", start, end), "departure")
    return hours.select(hour_label(F.col("hour")).alias("label"), "value")


def boat_availability(t: Tables, start: Day, end: Day) -> DataFrame:
    return rel.two_slots(t.boat, "isavailable", *AVAILABILITY_LABELS)


def boats_per_size(t: Tables, start: Day, end: Day, unknown: str | None = None) -> DataFrame:
    counts = t.boat.groupBy("boatsize").agg(F.count("*").alias("value"))
    label = F.col("boatsize") if unknown is None else F.coalesce("boatsize", F.lit(unknown))
    return counts.select("boatsize", label.alias("label"), "value")


# -- means and rates -----------------------------------------------------------


def safety(t: Tables, start: Day, end: Day, checks: dict, real_only: bool = False) -> DataFrame:
    trips = date_range(t.trip, "departure", start, end)
    if real_only:
        trips = trips.filter(F.col("status") != SEED_STATUS)
    return rel.flag_rates(trips, checks)


def speed_per_boat(t: Tables, start: Day, end: Day) -> DataFrame:
    speed = F.col("iot_speedKnots")
    return (
        t.boat.filter(speed.isNotNull())
        .groupBy("boatid", F.col("boatno").alias("label"))
        .agg(ratio(F.sum(speed), F.count(speed)).alias("value"))
    )


def speed_by_size(t: Tables, start: Day, end: Day) -> DataFrame:
    speed = F.col("iot_speedKnots")
    means = (
        t.boat.filter(speed.isNotNull())
        .groupBy(F.col("boatsize").alias("label"))
        .agg(ratio(F.sum(speed), F.count(speed)).alias("mean"))
    )
    return means.withColumn("value", F.round("mean", 2))


def capacity_vs_passengers(t: Tables, start: Day, end: Day) -> DataFrame:
    trips = date_range(t.trip, "departure", start, end)
    pax = F.col("noofpassengers")
    return capacity_rows(t, rel.per_key(trips, "boatid", F.sum(pax).alias("pax"), F.count(pax).alias("n")))


def capacity_rows(t: Tables, per_boat: DataFrame) -> DataFrame:
    """Capacity beside mean passengers, from each boat's passengers and trips that have a number."""
    boats = rel.with_dimension(per_boat, t.boat, "boatid", "boatno", "boatcapacity")
    return boats.select(
        "boatid",
        "boatcapacity",
        F.col("boatno").alias("label"),
        F.coalesce("boatcapacity", F.lit(0)).alias("capacity"),
        F.coalesce(F.round(ratio(F.col("pax"), F.col("n")), 1), F.lit(0.0)).alias("avg_passengers"),
    )


def trip_duration(t: Tables, start: Day, end: Day) -> DataFrame:
    """Mean hours per departure day, then one row over all trips (NULL label,
    ``is_total``).  The overall mean weighs every trip alike."""
    trips = date_range(t.trip, "departure", start, end)
    seconds = seconds_between(F.col("departure"), F.col("arrival"))
    timed = trips.select(F.to_date("departure").alias("day"), seconds.alias("seconds"))
    # A missing departure or arrival gives NULL seconds, which this drops too.
    daily = (
        timed.filter(F.col("seconds") > 0)
        .groupBy("day")
        .agg(F.sum("seconds").alias("seconds"), F.count("*").alias("trip_count"))
    )
    return duration_rows(daily)


def duration_rows(daily: DataFrame) -> DataFrame:
    """Mean hours per day, and over all, from each day's seconds and trips."""
    rows = rel.detail_and_total(daily, "day", ["seconds", "trip_count"])
    hours = ratio(F.col("seconds"), F.col("trip_count") * 3600)
    return rows.select(
        F.col("day").cast("string").alias("label"),
        F.coalesce(F.round(hours, 2), F.lit(0.0)).alias("value"),
        "trip_count",
        "is_total",
    )


# -- registry ------------------------------------------------------------------


def _named(name: str, kind: str | None = None) -> dict[str, tuple[str | None, str | None]]:
    return {"value": (name, kind)}


_PAID = partial(payment_counts, labels=PAID_LABELS)

FLEET = {
    "monthly_revenue": Report(monthly_revenue, _by("label"), _named("Monthly Revenue")),
    "passenger_trends": Report(passenger_trends, _by("label"), _named("Passengers per Day")),
    "revenue_by_boat_size": Report(revenue_by_size, _by("-total", "label"), _named("Revenue")),
    "paid_unpaid": Report(_PAID, _in_order(PAID_LABELS)),
    "top_drivers": Report(trips_per_driver, _by("-value", "driverid"), _named("Trips"), 10),
    "cancelled_by_driver": Report(
        partial(trips_per_driver, cancelled_only=True),
        _by("-value", "driverid"),
        _named("Cancelled Trips"),
        10,
    ),
    "safety_compliance": Report(
        partial(safety, checks=SAFETY_CHECKS),
        _in_order(tuple(SAFETY_CHECKS.values())),
        _named("Compliance %"),
    ),
    "inspections_by_personnel": Report(
        inspections, _by("-value", "inspectedby"), _named("Trips Inspected"), 15
    ),
    "avg_speed_per_boat": Report(
        speed_per_boat, _by("-value", "boatid"), _named("Avg Speed (Knots)"), 15
    ),
    "revenue_by_tour_type": Report(
        revenue_by_tour_type, _by("-total", "label"), _named("Revenue"), 10
    ),
    "capacity_vs_passengers": Report(
        capacity_vs_passengers,
        _by("-boatcapacity", "boatid"),
        {"capacity": ("Capacity", "bar"), "avg_passengers": ("Avg Passengers", "line")},
        15,
    ),
    "payment_completion": Report(
        partial(payment_counts, labels=COMPLETION_LABELS), _in_order(COMPLETION_LABELS)
    ),
    "avg_speed_by_size": Report(
        speed_by_size, _by("-mean", "label"), _named("Avg Speed (Knots)")
    ),
    "peak_hours": Report(peak_hours, _by("label"), _named("Departures")),
}

ACTIVITY = {
    "trips_per_boat": Report(trips_per_boat, _by("-value", "boatid")),
    "boat_availability": Report(boat_availability, _in_order(AVAILABILITY_LABELS)),
    "boat_size": Report(
        partial(boats_per_size, unknown=UNKNOWN),
        _in_order(SIZE_ORDER, "boatsize"),
    ),
    "trip_duration": Report(
        trip_duration, _by("is_total", "label"), extra=("trip_count", "is_total")
    ),
}


_OVERVIEW = {
    "trips_per_boat": Report(
        partial(trips_per_boat, real_only=True), _by("-value", "boatid"), limit=10
    ),
    "monthly_revenue": Report(partial(monthly_revenue, dated_only=True), _by("label")),
    "revenue_by_size": Report(partial(revenue_by_size, known_only=True), _in_order(SIZE_ORDER)),
    "paid_unpaid": Report(_PAID, _in_order(PAID_LABELS)),
    "boat_availability": Report(boat_availability, _in_order(AVAILABILITY_LABELS)),
    "boat_size_distribution": Report(boats_per_size, _in_order(SIZE_ORDER)),
    "top_drivers": Report(
        partial(trips_per_driver, real_only=True), _by("-value", "driverid"), limit=10
    ),
    "trips_by_status": Report(trips_by_status, _by("-value", "status")),
    "avg_speed_by_size": Report(speed_by_size, _in_order(SIZE_ORDER)),
    "safety_compliance": Report(
        partial(safety, checks=REAL_TRIP_CHECKS, real_only=True),
        _in_order(tuple(REAL_TRIP_CHECKS.values())),
    ),
}
OVERVIEW = {key: replace(report, dated=False) for key, report in _OVERVIEW.items()}

DASHBOARDS: dict[str, dict[str, Report]] = {
    "fleet": FLEET,
    "activity": ACTIVITY,
    "overview": OVERVIEW,
}


def find(key: str, dashboard: str = "fleet") -> Report:
    try:
        return DASHBOARDS[dashboard][key]
    except KeyError:
        raise ValueError(f"unknown report: {dashboard}/{key}") from None


def run(
    key: str, tables: Tables, start: Day = None, end: Day = None, dashboard: str = "fleet"
) -> DataFrame:
    """A report by name: ``label`` and its value columns, in report order."""
    report = find(key, dashboard)
    return report.shown(report.limited(tables, start, end))
