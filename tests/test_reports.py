import json
from decimal import Decimal

import pytest

from fleetboard.plans import (
    DASHBOARDS,
    find,
    open_dashboard,
    payload,
    payload_json,
    payload_text,
    run,
    run_dashboard,
    stacked_dashboard,
)

from .fixtures import star


@pytest.fixture(scope="module")
def tables(spark):
    return star(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return star(spark, [], [], [])


def rows(key, tables, start=None, end=None, dashboard="fleet"):
    return [tuple(r) for r in run(key, tables, start, end, dashboard).collect()]


def test_monthly_revenue_keeps_undated_trips_as_a_null_month(tables):
    assert rows("monthly_revenue", tables) == [
        (None, 5.0), ("2026-01", 160.75), ("2026-02", 21.0), ("2026-03", 9.0)]
    assert rows("monthly_revenue", tables, dashboard="overview") == [
        ("2026-01", 160.75), ("2026-02", 21.0), ("2026-03", 9.0)]


@pytest.mark.parametrize(
    "start, end, months",
    [
        ("2026-02-01", None, ["2026-02", "2026-03"]),
        (None, "2026-01-31", ["2026-01"]),
        ("2026-02-01", "2026-02-28", ["2026-02"]),
        ("", "", [None, "2026-01", "2026-02", "2026-03"]),
    ],
)
def test_each_bound_is_optional(tables, start, end, months):
    assert [r[0] for r in rows("monthly_revenue", tables, start, end)] == months


def test_end_date_includes_its_last_instant(tables):
    assert rows("monthly_revenue", tables, "2026-01-31", "2026-01-31") == [("2026-01", 10.0)]


def test_passenger_trends_null_day_and_null_sum(tables):
    assert rows("passenger_trends", tables)[:3] == [(None, 2), ("2026-01-05", 9), ("2026-01-31", 1)]
    assert ("2026-02-01", 0) in rows("passenger_trends", tables)


def test_revenue_by_size(tables):
    assert rows("revenue_by_boat_size", tables) == [
        ("Small", 151.75), ("Medium", 30.0), (None, 7.0), ("Large", 5.0), ("Giant", 0.0)]
    # Unlisted and NULL sizes come first, and a size without amounts is not there.
    assert rows("revenue_by_size", tables, dashboard="overview") == [
        (None, 7.0), ("Small", 151.75), ("Medium", 30.0), ("Large", 5.0)]


def test_payment_codes(tables):
    assert rows("paid_unpaid", tables) == [("Paid", 5), ("Unpaid / Pending", 3)]
    assert rows("payment_completion", tables) == [("Completed", 5), ("Outstanding", 3)]


def test_drivers(tables):
    # Equal counts fall in order of the id; a missing last name makes the name NULL.
    assert rows("top_drivers", tables) == [
        ("Ana Cruz", 2), (None, 2), ("Cy Diaz", 2), ("DEFAULT FN", 1)]
    assert rows("top_drivers", tables, dashboard="overview") == [
        ("Ana Cruz", 2), (None, 2), ("Cy Diaz", 2)]
    assert rows("cancelled_by_driver", tables) == [("DEFAULT FN", 1), ("Cy Diaz", 1)]
    assert rows("cancelled_by_driver", tables, None, "2026-02-28") == [("DEFAULT FN", 1)]


def test_safety(tables):
    got = dict(rows("safety_compliance", tables))
    assert list(got) == ["Life Vest", "Children Vest", "Fire Ext.", "Trash Bin", "Gas", "Helper",
                         "Uniform ID"]
    assert got["Life Vest"] == 50.0 and got["Gas"] == 100.0 and got["Helper"] == 0.0
    real = dict(rows("safety_compliance", tables, dashboard="overview"))
    assert real["Life Vest"] == 66.7 and len(real) == 6


def test_inspections_drop_zero_and_null(tables):
    assert rows("inspections_by_personnel", tables) == [("User #7", 2), ("User #9", 1)]


def test_speeds(tables):
    assert rows("avg_speed_per_boat", tables)[:2] == [("B-5", 9.99), ("B-3", 7.0)]
    assert rows("avg_speed_by_size", tables) == [
        (None, 9.99), ("Large", 7.0), ("Medium", 6.13), ("Small", 5.1)]
    assert [r[0] for r in rows("avg_speed_by_size", tables, dashboard="overview")] == [
        None, "Small", "Medium", "Large"]


def test_tour_types_drop_null_and_blank(tables):
    assert rows("revenue_by_tour_type", tables) == [("A", 101.5), ("B", 50.25)]


def test_capacity(tables):
    got = rows("capacity_vs_passengers", tables)
    assert got[:2] == [("B-2", 20, 1.0), ("B-4", 20, 3.0)]
    assert got[-1] == ("B-3", 0, 2.0)


def test_peak_hours_has_every_hour(tables):
    got = dict(rows("peak_hours", tables))
    assert list(got) == [f"{h:02d}:00" for h in range(24)]
    assert got["08:00"] == 2 and got["17:00"] == 2 and got["03:00"] == 0


def test_trips_per_boat(tables):
    assert rows("trips_per_boat", tables, dashboard="activity")[:2] == [("B-1", 2), ("B-2", 2)]
    assert "B-0" not in dict(rows("trips_per_boat", tables, dashboard="overview"))


def test_availability_is_one_or_anything_else(tables):
    assert rows("boat_availability", tables, dashboard="activity") == [
        ("Available", 3), ("Not Available", 4)]


def test_boat_sizes(tables):
    assert rows("boat_size", tables, dashboard="activity") == [
        ("Unknown", 1), ("Giant", 1), ("Small", 2), ("Medium", 2), ("Large", 1)]
    assert rows("boat_size_distribution", tables, dashboard="overview")[0] == (None, 1)


def test_duration_counts_positive_ones_only(tables):
    assert rows("trip_duration", tables, dashboard="activity") == [
        ("2026-01-05", 1.25, 2, False),
        ("2026-02-04", 1.25, 1, False),
        ("2026-03-02", 1.25, 1, False),
        (None, 1.25, 4, True),
    ]


def test_status_blank_and_stored_unknown_stay_apart(tables):
    got = rows("trips_by_status", tables, dashboard="overview")
    assert got[0] == ("Done", 4) and got.count(("Unknown", 1)) == 2 and len(got) == 4


def test_empty_tables_give_zeros(empty):
    assert rows("paid_unpaid", empty) == [("Paid", 0), ("Unpaid / Pending", 0)]
    assert dict(rows("safety_compliance", empty))["Gas"] == 0.0
    assert len(rows("peak_hours", empty)) == 24
    assert rows("trip_duration", empty, dashboard="activity") == [(None, 0.0, 0, True)]
    assert rows("boat_availability", empty, dashboard="activity")[1] == ("Not Available", 0)
    assert rows("top_drivers", empty) == []


def test_unknown_report():
    with pytest.raises(ValueError):
        find("nothing")
    with pytest.raises(ValueError):
        find("monthly_revenue", "nowhere")


def test_bad_date(tables):
    with pytest.raises(ValueError):
        run("monthly_revenue", tables, "January")


def test_bounds_reach_the_scan(spark, tables, tmp_path):
    path = str(tmp_path / "trips")
    tables.trip.write.parquet(path)
    stored = type(tables)(spark.read.parquet(path), tables.boat, tables.driver)
    plan = run("passenger_trends", stored, "2026-01-01", "2026-01-31")._jdf.queryExecution().toString()
    scan = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(departure,2026-01-01T00:00)" in scan
    assert "LessThan(departure,2026-02" in scan
    assert "ReadSchema: struct<departure:timestamp_ntz,noofpassengers:int>" in scan


def test_every_report_of_a_dashboard_with_and_without_kept_trips(tables):
    for name, reports in DASHBOARDS.items():
        dates = ("2026-01-01", "2026-02-28")
        plain = {k: df.collect() for k, df in run_dashboard(name, tables, *dates).items()}
        with open_dashboard(name, tables, *dates) as frames:
            assert {k: df.collect() for k, df in frames.items()} == plain
        assert list(plain) == list(reports)


def test_stacked_dashboard(tables):
    got = stacked_dashboard("fleet", tables).collect()
    assert {r["report"] for r in got} == set(DASHBOARDS["fleet"])
    assert ("paid_unpaid", "paid_unpaid", "Paid", 5.0, False) in [tuple(r) for r in got]


def test_stacked_dashboard_keeps_totals(tables):
    got = stacked_dashboard("activity", tables).filter("report = 'trip_duration'").collect()
    plain = run("trip_duration", tables, dashboard="activity").collect()
    for column, series in (("value", "trip_duration"), ("trip_count", "trip_count")):
        assert {(r["label"], r["value"], r["is_total"]) for r in got if r["series"] == series} == {
            (r["label"], float(r[column]), r["is_total"]) for r in plain
        }
    with pytest.raises(ValueError):
        stacked_dashboard("none", tables)


def test_named_and_positional_parameters(tables):
    named = tables.sql(
        "select count(*) as n from {trip} where departure >= :a and status = :s",
        {"a": "2026-02-01", "s": "Done"},
    )
    assert named.first()["n"] == 2
    positional = tables.sql("select count(*) as n from {boat} where boatsize = ?", ["x' or '1'='1"])
    assert positional.first()["n"] == 0


# -- payloads ---------------------------------------------------------------------------------


def records(df):
    head, *points = [json.loads(r["json"]) for r in payload_json(df).orderBy("place").collect()]
    return head, points


def whole(*args, **more):
    return json.loads("".join(r["text"] for r in payload_text(*args, **more).collect()))


def test_payload_with_datasets(tables):
    head, points = records(payload("capacity_vs_passengers", tables))
    assert head["series"] == [
        {"label": "Capacity", "type": "bar"}, {"label": "Avg Passengers", "type": "line"}]
    assert head["points"] == len(points)
    assert [p["label"] for p in points][:2] == ["B-2", "B-4"]
    assert [p["values"][1] for p in points][:2] == [1.0, 3.0]
    one = whole("capacity_vs_passengers", tables)
    assert one["labels"] == [p["label"] for p in points]
    assert [(d["label"], d["type"]) for d in one["datasets"]] == [("Capacity", "bar"), ("Avg Passengers", "line")]
    assert [list(v) for v in zip(*[d["data"] for d in one["datasets"]])] == [p["values"] for p in points]


def test_payload_with_scalars(tables, empty):
    days = ["2026-01-05", "2026-02-04", "2026-03-02"]
    head, points = records(payload("trip_duration", tables, dashboard="activity"))
    assert (head["points"], head["overall_avg"], head["trip_count"]) == (3, 1.25, 4)
    assert points == [{"label": d, "values": [1.25]} for d in days]
    assert whole("trip_duration", tables, dashboard="activity") == {
        "labels": days, "data": [1.25] * 3, "overall_avg": 1.25, "trip_count": 4}
    assert whole("trip_duration", empty, dashboard="activity") == {
        "labels": [], "data": [], "overall_avg": 0.0, "trip_count": 0}


@pytest.mark.parametrize("group_rows", [1_000_000, 2])
def test_payload_keeps_order(tables, group_rows):
    order = [r[0] for r in rows("trips_per_boat", tables, dashboard="activity")]
    head, points = records(payload("trips_per_boat", tables, dashboard="activity", group_rows=group_rows))
    assert [p["label"] for p in points] == order and head["points"] == len(order)


def test_payload_of_nothing(empty):
    head, points = records(payload("monthly_revenue", empty))
    assert points == [] and head["points"] == 0
    assert whole("monthly_revenue", empty)["labels"] == []


def test_null_label_in_payload(tables):
    assert whole("boat_size_distribution", tables, dashboard="overview") == {
        "labels": [None, "Giant", "Small", "Medium", "Large"], "data": [1, 1, 2, 2, 1]}


def test_sums_of_the_largest_amounts(spark):
    from fleetboard.operators.relational import sum_exact

    most = "cast(9999999999999999.99 as decimal(18,2))"
    df = spark.range(12_000_000).selectExpr("1 as k", f"{most} as amount")
    assert sum_exact(df, ["k"], "amount", "total").first()["total"] == 12_000_000 * Decimal("9999999999999999.99")
    with pytest.raises(TypeError, match="decimal"):
        sum_exact(spark.range(1), ["id"], "id", "total")


def test_seconds_do_not_depend_on_the_session_zone(spark):
    from fleetboard.functions import seconds_between

    df = spark.sql("select timestamp_ntz'2026-03-29 00:30:00' as a, timestamp_ntz'2026-03-29 05:30:00' as b")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(seconds_between(df["a"], df["b"]).alias("s")).first()["s"] == 5 * 3600
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
