"""Dashboards from shared summaries against reports that read the trips themselves."""

from __future__ import annotations

import pytest

from checks.adapter import SCHEMAS, star
from fleetboard import session
from fleetboard.operators import relational as rel
from fleetboard.plans import DASHBOARDS, open_dashboard, run_dashboard, shared, stacked_dashboard
from fleetboard.schema import Tables

from . import fixtures


@pytest.fixture(scope="module")
def tables(spark):
    return fixtures.star(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return fixtures.star(spark, [], [], [])


RANGES = [(None, None), ("2026-01-01", "2026-01-31"), ("2026-01-03", ""), (None, "2026-01-02"), ("2030-01-01", None)]


def found(frames: dict) -> dict:
    return {key: [tuple(r) for r in df.collect()] for key, df in frames.items()}


@pytest.mark.parametrize("dashboard", DASHBOARDS)
@pytest.mark.parametrize("days", RANGES)
def test_shared_reports_are_the_reports(tables, dashboard, days):
    assert found(run_dashboard(dashboard, tables, *days)) == found(run_dashboard(dashboard, tables, *days, shared=False))


@pytest.mark.parametrize("dashboard", DASHBOARDS)
def test_shared_reports_of_nothing(empty, dashboard):
    assert found(run_dashboard(dashboard, empty)) == found(run_dashboard(dashboard, empty, shared=False))


def test_open_dashboard_in_three_ways(tables):
    ways = []
    for persist in (None, True, False):
        with open_dashboard("fleet", tables, "2026-01-01", "2026-01-31", persist) as frames:
            ways.append(found(frames))
    assert ways[0] == ways[1] == ways[2]
    with pytest.raises(ValueError):
        run_dashboard("none", tables)


def test_every_trip_report_is_rewritten():
    """What has no rewrite reads dimensions only."""
    left = {(d, key) for d, reports in DASHBOARDS.items() for key in reports if key not in shared.REWRITES[d]}
    assert left == {
        ("fleet", "avg_speed_per_boat"), ("fleet", "avg_speed_by_size"), ("activity", "boat_availability"),
        ("activity", "boat_size"), ("overview", "boat_availability"), ("overview", "boat_size_distribution"),
        ("overview", "avg_speed_by_size"),
    }


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trips_are_read_once_for_every_grain(spark, sf_dir, monkeypatch):
    read = []
    write = shared.checkpoint

    def counted(df):
        read.append(df.select("*"))
        return write(df)

    monkeypatch.setattr(shared, "checkpoint", counted)
    tables = star(spark, sf_dir)
    whole = stacked_dashboard("fleet", tables, "1996-01-01", "1997-12-31")
    assert len(read) == 6
    scans = [p for df in read for p in [plan(df)]]
    assert all(p.count("l_orderkey") and p.count("Relation [l_") == 1 for p in scans)
    # The reports themselves read summaries and dimensions.
    assert "Relation [l_" not in plan(whole) and "Relation [o_" not in plan(whole)
    # Each reads only the columns of its measures: the driver counts no money.
    assert "l_extendedprice" in "".join(scans) and sum("l_extendedprice" in p.split("Aggregate")[-1].split("Join")[0] for p in scans) <= 3
    assert whole.count() > 100


def test_parts_of_groups_add_up(spark):
    from decimal import Decimal

    from pyspark.sql import functions as F

    df = spark.range(1000).selectExpr("id % 7 as k", "cast((id - 400) * 99999999999.37 as decimal(18,2)) as amount")
    parts = df.groupBy("k").agg(*[c.alias(p) for p, c in rel.exact_parts(df, "amount").items()])
    whole = parts.agg(*[F.sum(p).alias(p) for p in rel.PARTS])
    total = whole.select(rel.exact_total({p: F.col(p) for p in rel.PARTS}, df.schema["amount"].dataType)).first()[0]
    assert total == sum((r["amount"] for r in df.collect()), Decimal(0))


def test_grains_of_the_same_trips_share_one_copy(spark, monkeypatch):
    """A row of the trips is made once, however many grains add it up."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    plain = fixtures.star(spark)
    tables = Tables(plain.trip.mapInArrow(seen, plain.trip.schema), plain.boat, plain.driver)
    kept = []
    keep = shared.kept
    monkeypatch.setattr(shared, "kept", lambda df: kept.append(df) or keep(df))
    n = plain.trip.count()
    for dashboard in DASHBOARDS:
        made.value = 0
        frames = run_dashboard(dashboard, tables)
        assert made.value == n
        assert found(frames) == found(run_dashboard(dashboard, plain, shared=False))
    # Bounds are on one column for some grains and on another for one.
    made.value = 0
    frames = run_dashboard("fleet", tables, "2026-01-01", "2026-01-31")
    assert made.value == 2 * n
    assert found(frames) == found(run_dashboard("fleet", plain, "2026-01-01", "2026-01-31", shared=False))
    assert len(kept) == len(DASHBOARDS) + 1 and not any(df.storageLevel.useMemory for df in kept)
    # One grain alone needs no copy, and no column that it does not add up.
    some = shared.limited_reports("fleet", tables, keys=["top_drivers", "avg_speed_by_size"])
    assert len(kept) == len(DASHBOARDS) + 1 and some["top_drivers"].count() > 0
    assert not any("orderid" in df.columns for df in kept)
    assert set(shared.READS) == {*shared.MEASURES, shared.AMOUNT}


def written_tables(spark, folder) -> Tables:
    """Trips as a join of two files: orders of a year, some with their key twice or
    without one, and lines, some without an order or a key."""
    made = {
        "orders": spark.range(2000).selectExpr(
            "nullif(id % 1900, 7) as o_orderkey", "id as o_custkey", "if(id % 9 = 0, 'P', 'F') as o_orderstatus",
            "0D as o_totalprice", "cast(date_add(date'2026-01-01', cast(id % 365 as int)) as timestamp_ntz) as o_orderdate",
            "element_at(array('1-URGENT', '4-NOT SPECIFIED', '5-LOW'), cast(id % 3 as int) + 1) as o_orderpriority",
        ),
        "lineitem": spark.range(8000).selectExpr(
            "nullif(id % 2100, 11) as l_orderkey", "id % 50 as l_partkey", "id % 20 as l_suppkey",
            "cast(id % 7 + 1 as int) as l_linenumber", "cast(id % 40 as double) as l_quantity",
            "cast(id as double) as l_extendedprice", "id % 9 / 100D as l_discount", "id % 7 / 100D as l_tax",
            "if(id % 3 = 0, 'R', 'N') as l_returnflag", "'F' as l_linestatus",
            "cast(date_add(date'2026-01-05', cast(id % 365 as int)) as timestamp_ntz) as l_shipdate",
        ),
        "part": spark.range(50).selectExpr(
            "id as p_partkey", "'p' as p_name", "'b' as p_brand", "if(id % 2 = 0, 'SMALL', 'LARGE') as p_type",
            "cast(id as int) as p_size", "cast(id as double) as p_retailprice",
        ),
        "supplier": spark.range(20).selectExpr(
            "id as s_suppkey", "concat('Supplier#', id) as s_name", "1 as s_nationkey", "0D as s_acctbal"
        ),
    }
    for name, df in made.items():
        types = spark.createDataFrame([], SCHEMAS[name]).schema
        df.select(*[df[f.name].cast(f.dataType) for f in types]).write.parquet(f"{folder}/{name}.parquet")
    return star(spark, str(folder))


def test_bounds_prune_the_join_of_the_trips(spark, tmp_path, monkeypatch):
    """Rows of the unbounded table go before they are shuffled; the rows that stay are the same."""
    tables = written_tables(spark, tmp_path)
    plans = []
    keep = shared.kept
    # A plan is made when it is asked for, that is under the settings of the moment.
    monkeypatch.setattr(shared, "kept", lambda df: plans.append(plan(df)) or keep(df))
    # The files are small: nothing is broadcast, and no scan is too small to be pruned.
    monkeypatch.setitem(session.PRUNED_JOINS, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    before = {name: spark.conf.get(name) for name in session.PRUNED_JOINS}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for dashboard, *days in (("fleet", "2026-02-01", "2026-03-31"), ("activity", None, "2026-01-20")):
            plans.clear()
            frames = run_dashboard(dashboard, tables, *days)
            assert len(plans) == 1 and "might_contain" in plans[0]
            assert {name: spark.conf.get(name) for name in before} == before
            assert found(frames) == found(run_dashboard(dashboard, tables, *days, shared=False))
        # Without bounds every key has its rows, and nothing is to be pruned.
        plans.clear()
        run_dashboard("fleet", tables)
        assert len(plans) == 1 and "might_contain" not in plans[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    with pytest.raises(ZeroDivisionError), session.pruned_joins(spark):
        assert {name: spark.conf.get(name) for name in before} == session.PRUNED_JOINS
        1 / 0
    assert {name: spark.conf.get(name) for name in before} == before
