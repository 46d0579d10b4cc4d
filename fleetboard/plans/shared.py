"""One pass over the trips for several reports.

Reports of a dashboard ask the same trips for different sums.  Here the trips are
added up once per *grain* (day and hour, boat, driver, ...) into a summary that
holds every sum the dashboard's reports need at that grain.  Summaries are
mergeable: counts and whole-number sums add up, so a month, an hour of the day or
the whole fleet is a sum over the rows of a finer grain.  Each report is then a
rewrite from a summary, which is small, to its rows.

A summary is written down before it is used: without that, every report would
prune it to its own columns and read the trips again.

The trips themselves may come from a join of tables that both grow.  So grains of
the same trips do not each make them: one copy, of the columns that they add up, is
kept while their summaries are made.  Where bounds hold for one table of the join, rows
of the other that they rule out are dropped before the join shuffles them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetboard.functions import full_name, hour_label, month_label, null_if_blank, percent, ratio, seconds_between
from fleetboard.operators import relational as rel
from fleetboard.operators.filters import Day, as_day, date_range
from fleetboard.schema import SAFETY_CHECKS, Tables
from fleetboard.session import checkpoint, pruned_joins

from . import reports as R

# -- what trips are added up by -------------------------------------------------------


@dataclass(frozen=True)
class Grain:
    """Columns that trips are added up by, which of the trips count, and the column
    whose days the bounds are on.  ``reads`` are the columns behind all that."""

    keys: Callable[[], list[Column]]
    reads: tuple[str, ...]
    where: str | None = None
    day: str = "departure"

    def trips(self, t: Tables, start: Day, end: Day) -> DataFrame:
        trips = date_range(t.trip, self.day, start, end)
        return trips if self.where is None else trips.filter(self.where)


def _per(name: str, where: str | None = None) -> Grain:
    return Grain(lambda: [F.col(name)], (name,), where)


GRAINS = {
    "time": Grain(lambda: [F.to_date("departure").alias("day"), F.hour("departure").alias("hour")], ("departure",)),
    "boat": _per("boatid"),
    "driver": _per("driverid", "driverid is not null"),
    "cancelled": Grain(
        lambda: [F.col("driverid")],
        ("driverid", "datecancelled"),
        "datecancelled is not null and driverid is not null",
        "datecancelled",
    ),
    "inspector": _per("inspectedby", "inspectedby != 0"),
    "tour": _per("islandtourtype", "islandtourtype != ''"),
    "status": _per("status", f"status != '{R.SEED_STATUS}'"),
}

# -- what is added up -----------------------------------------------------------------


def _real() -> Column:
    return F.col("status") != R.SEED_STATUS


def _seconds() -> Column:
    """Of a trip that arrived after it left, else NULL."""
    taken = seconds_between(F.col("departure"), F.col("arrival"))
    return F.when(taken > 0, taken)


MEASURES: dict[str, Callable[[], Column]] = {
    "trips": lambda: F.count("*"),
    "real_trips": lambda: F.count_if((F.col("driverid") != R.PLACEHOLDER_DRIVER) & _real()),
    "amounts": lambda: F.count("boatamount"),
    "pax": lambda: F.sum("noofpassengers"),
    "pax_n": lambda: F.count("noofpassengers"),
    "paid": lambda: F.count_if(F.col("ispaid") == 1),
    "unpaid": lambda: F.count_if((F.col("ispaid") == 0) | F.col("ispaid").isNull()),
    "seconds": lambda: F.sum(_seconds()),
    "timed": lambda: F.count(_seconds()),
}
for _check in SAFETY_CHECKS:
    MEASURES |= {
        f"{_check}_sum": partial(lambda c: F.sum(c), _check),
        f"{_check}_n": partial(lambda c: F.count(c), _check),
        f"real_{_check}_sum": partial(lambda c: F.sum(F.when(_real(), F.col(c))), _check),
        f"real_{_check}_n": partial(lambda c: F.count(F.when(_real(), F.col(c))), _check),
    }
AMOUNT = "amount"  # the exact sum of boatamount, in its parts

# The columns that each measure reads.
READS: dict[str, tuple[str, ...]] = {
    AMOUNT: ("boatamount",),
    "trips": (),
    "real_trips": ("driverid", "status"),
    "amounts": ("boatamount",),
    "pax": ("noofpassengers",),
    "pax_n": ("noofpassengers",),
    "paid": ("ispaid",),
    "unpaid": ("ispaid",),
    "seconds": ("departure", "arrival"),
    "timed": ("departure", "arrival"),
}
for _check in SAFETY_CHECKS:
    READS |= {f"{_check}_{x}": (_check,) for x in ("sum", "n")}
    READS |= {f"real_{_check}_{x}": (_check, "status") for x in ("sum", "n")}


def summary(t: Tables, grain: str, measures: Sequence[str], start: Day = None, end: Day = None) -> DataFrame:
    """One row per key of the grain with the measures asked for."""
    of = GRAINS[grain]
    aggs: list[Column] = []
    for name in sorted(set(measures)):
        if name == AMOUNT:
            aggs += [c.alias(f"{AMOUNT}_{part}") for part, c in rel.exact_parts(t.trip, "boatamount").items()]
        else:
            aggs.append(MEASURES[name]().alias(name))
    return of.trips(t, start, end).groupBy(*of.keys()).agg(*aggs)


def _merged(state: DataFrame, keys: Sequence[str | Column], *measures: str) -> DataFrame:
    """Rows of a summary added up by ``keys``; no keys give one row, also of no rows."""
    aggs = []
    for name in measures:
        parts = [f"{AMOUNT}_{p}" for p in rel.PARTS] if name == AMOUNT else [name]
        aggs += [F.sum(p).alias(p) for p in parts]
    return state.groupBy(*keys).agg(*aggs)


def _amount(t: Tables) -> Column:
    parts = {p: F.col(f"{AMOUNT}_{p}") for p in rel.PARTS}
    return rel.exact_total(parts, t.trip.schema["boatamount"].dataType)


# -- reports from summaries -----------------------------------------------------------


def monthly_revenue(t: Tables, s: DataFrame, dated_only: bool = False) -> DataFrame:
    days = s.filter((F.col("amounts") > 0) & (F.col("day").isNotNull() if dated_only else F.lit(True)))
    months = _merged(days, [F.trunc("day", "MM").alias("month")], AMOUNT)
    value = F.coalesce(_amount(t).cast("double"), F.lit(0.0))
    return months.select(month_label(F.col("month")).alias("label"), value.alias("value"))


def passenger_trends(t: Tables, s: DataFrame) -> DataFrame:
    days = _merged(s, ["day"], "pax")
    return days.select(F.col("day").cast("string").alias("label"), F.coalesce("pax", F.lit(0)).cast("bigint").alias("value"))


def payment_counts(t: Tables, s: DataFrame, labels: tuple[str, str]) -> DataFrame:
    counts = _merged(s, [], "paid", "unpaid")
    counts = counts.select(*[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("paid", "unpaid")])
    return rel.measures_to_rows(counts, dict(zip(("paid", "unpaid"), labels, strict=True)))


def safety(t: Tables, s: DataFrame, checks: dict[str, str], prefix: str = "") -> DataFrame:
    sums = _merged(s, [], *[f"{prefix}{c}_{x}" for c in checks for x in ("sum", "n")])
    rates = [percent(F.col(f"{prefix}{c}_sum"), F.coalesce(f"{prefix}{c}_n", F.lit(0))).alias(c) for c in checks]
    return rel.measures_to_rows(sums.select(*rates), checks)


def peak_hours(t: Tables, s: DataFrame) -> DataFrame:
    counts = _merged(s.filter(F.col("hour").isNotNull()), ["hour"], "trips").withColumnRenamed("trips", "value")
    hours = rel.every_hour(counts)
    return hours.select(hour_label(F.col("hour")).alias("label"), "value")


def trip_duration(t: Tables, s: DataFrame) -> DataFrame:
    daily = _merged(s.filter(F.col("timed") > 0), ["day"], "seconds", "timed").withColumnRenamed("timed", "trip_count")
    return R.duration_rows(daily)


def revenue_by_size(t: Tables, s: DataFrame, known_only: bool = False) -> DataFrame:
    per_boat = s.filter("amounts > 0") if known_only else s
    per_boat = per_boat.select("boatid", _amount(t).alias("amount"))
    return R.size_totals(rel.with_dimension(per_boat, t.boat, "boatid", "boatsize"))


def capacity_vs_passengers(t: Tables, s: DataFrame) -> DataFrame:
    return R.capacity_rows(t, s.select("boatid", "pax", F.col("pax_n").alias("n")))


def trips_per_boat(t: Tables, s: DataFrame, real_only: bool = False) -> DataFrame:
    counts = s.select("boatid", F.col("trips").alias("value"))
    return R.named_boats(t, counts.filter("boatid != 0") if real_only else counts)


def trips_per_driver(t: Tables, s: DataFrame, measure: str = "trips") -> DataFrame:
    return R.named_drivers(t, s.select("driverid", F.col(measure).alias("value")).filter("value > 0"))


def inspections(t: Tables, s: DataFrame) -> DataFrame:
    return R.named_inspectors(s.select("inspectedby", F.col("trips").alias("value")))


def revenue_by_tour_type(t: Tables, s: DataFrame) -> DataFrame:
    total = _amount(t)
    value = F.coalesce(total.cast("double"), F.lit(0.0))
    return s.select(F.col("islandtourtype").alias("label"), total.alias("total"), value.alias("value"))


def trips_by_status(t: Tables, s: DataFrame) -> DataFrame:
    return s.select("status", F.col("trips").alias("value"), null_if_blank(F.col("status"), R.UNKNOWN).alias("label"))


# -- which report is made of what -----------------------------------------------------


@dataclass(frozen=True)
class Rewrite:
    """A report as a function of one summary."""

    grain: str
    measures: tuple[str, ...]
    rows: Callable[[Tables, DataFrame], DataFrame]


def _payments(labels: tuple[str, str]) -> Rewrite:
    return Rewrite("time", ("paid", "unpaid"), partial(payment_counts, labels=labels))


def _checks(checks: dict[str, str], prefix: str = "") -> Rewrite:
    names = tuple(f"{prefix}{c}_{x}" for c in checks for x in ("sum", "n"))
    return Rewrite("time", names, partial(safety, checks=checks, prefix=prefix))


REWRITES: dict[str, dict[str, Rewrite]] = {
    "fleet": {
        "monthly_revenue": Rewrite("time", (AMOUNT, "amounts"), monthly_revenue),
        "passenger_trends": Rewrite("time", ("pax",), passenger_trends),
        "revenue_by_boat_size": Rewrite("boat", (AMOUNT,), revenue_by_size),
        "paid_unpaid": _payments(R.PAID_LABELS),
        "top_drivers": Rewrite("driver", ("trips",), trips_per_driver),
        "cancelled_by_driver": Rewrite("cancelled", ("trips",), trips_per_driver),
        "safety_compliance": _checks(SAFETY_CHECKS),
        "inspections_by_personnel": Rewrite("inspector", ("trips",), inspections),
        "revenue_by_tour_type": Rewrite("tour", (AMOUNT,), revenue_by_tour_type),
        "capacity_vs_passengers": Rewrite("boat", ("pax", "pax_n"), capacity_vs_passengers),
        "payment_completion": _payments(R.COMPLETION_LABELS),
        "peak_hours": Rewrite("time", ("trips",), peak_hours),
    },
    "activity": {
        "trips_per_boat": Rewrite("boat", ("trips",), trips_per_boat),
        "trip_duration": Rewrite("time", ("seconds", "timed"), trip_duration),
    },
    "overview": {
        "trips_per_boat": Rewrite("boat", ("trips",), partial(trips_per_boat, real_only=True)),
        "monthly_revenue": Rewrite("time", (AMOUNT, "amounts"), partial(monthly_revenue, dated_only=True)),
        "revenue_by_size": Rewrite("boat", (AMOUNT, "amounts"), partial(revenue_by_size, known_only=True)),
        "paid_unpaid": _payments(R.PAID_LABELS),
        "top_drivers": Rewrite("driver", ("real_trips",), partial(trips_per_driver, measure="real_trips")),
        "trips_by_status": Rewrite("status", ("trips",), trips_by_status),
        "safety_compliance": _checks(R.REAL_TRIP_CHECKS, "real_"),
    },
}


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` stored while in use, for a result that feeds several outputs.  What
    does not fit in memory goes to disk; a lost executor's part is recomputed."""
    stored = df.persist()
    try:
        yield stored
    finally:
        stored.unpersist()


def _summaries(
    t: Tables, needed: dict[tuple[str, bool], set[str]], start: Day, end: Day
) -> dict[tuple[str, bool], DataFrame]:
    """The summary of every (grain, dated) with the measures it needs, written."""
    same: dict[tuple[str | None, bool], list[tuple[str, bool]]] = {}
    for grain, dated in needed:
        bounded = dated and bool(as_day(start) or as_day(end))
        same.setdefault((GRAINS[grain].day if bounded else None, dated), []).append((grain, dated))
    with ExitStack() as stack:
        if any(day is not None for day, _ in same):
            stack.enter_context(pruned_joins(t.trip.sparkSession))
        source = {}
        for (day, _), grains in same.items():
            trips = t.trip if day is None else date_range(t.trip, day, start, end)
            if len(grains) > 1:
                reads = {c for of in grains for c in (*GRAINS[of[0]].reads, *(c for m in needed[of] for c in READS[m]))}
                trips = stack.enter_context(kept(trips.select(*[c for c in t.trip.columns if c in reads])))
                # Filled by one job; the summaries beside each other would each begin to.
                trips.count()
            source |= dict.fromkeys(grains, Tables(trips, t.boat, t.driver))

        def made(of: tuple[str, bool]) -> DataFrame:
            return checkpoint(summary(source[of], of[0], tuple(needed[of])))

        # Beside each other, so that the last tasks of one leave no executor idle.
        with ThreadPoolExecutor(max(1, len(needed))) as pool:
            return dict(zip(needed, pool.map(made, needed), strict=True))


def limited_reports(
    dashboard: str, tables: Tables, start: Day = None, end: Day = None, keys: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """The reports ``keys`` of a dashboard, or all, with their sort keys, cut where one has a limit.

    Grains of the same trips share one copy of them, and each writes its summary in
    a job of its own; reports without a rewrite read dimensions only.
    """
    found = {k: r for k, r in R.DASHBOARDS[dashboard].items() if keys is None or k in keys}
    rewrites = {k: r for k, r in REWRITES[dashboard].items() if k in found}
    needed: dict[tuple[str, bool], set[str]] = {}
    for key, rewrite in rewrites.items():
        needed.setdefault((rewrite.grain, found[key].dated), set()).update(rewrite.measures)
    states = _summaries(tables, needed, start, end)
    out = {}
    for key, report in found.items():
        if key in rewrites:
            rewrite = rewrites[key]
            out[key] = report.cut(rewrite.rows(tables, states[rewrite.grain, report.dated]))
        else:
            out[key] = report.limited(tables, start, end)
    return out
