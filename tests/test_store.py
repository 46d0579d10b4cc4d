"""Stored results: read while the files are the same, made anew when they change."""

from __future__ import annotations

import os
import shutil

import pytest

from checks.adapter import star
from fleetboard.plans import ResultStore, files_state, run, shared

from . import fixtures


@pytest.fixture
def folder(sf_dir, tmp_path):
    for name in ("lineitem", "orders", "part", "supplier"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path)
    return str(tmp_path)


@pytest.fixture
def made(monkeypatch):
    """The summaries that are made, each of which reads the trips once."""
    grains = []
    plain = shared.summary

    def counted(tables, grain, *rest):
        grains.append(grain)
        return plain(tables, grain, *rest)

    monkeypatch.setattr(shared, "summary", counted)
    return grains


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_second_call_reads_no_trip(spark, folder, made, tmp_path):
    store = ResultStore(spark, f"{tmp_path}/results")
    first = rows(store.run("top_drivers", star(spark, folder), "1996-01-01", "1996-12-31"))
    assert made == ["driver"]
    again = store.run("top_drivers", star(spark, folder), "1996-01-01", "1996-12-31")
    assert made == ["driver"] and rows(again) == first
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "s_suppkey" not in plan
    assert first == rows(run("top_drivers", star(spark, folder), "1996-01-01", "1996-12-31"))
    # Other bounds are another request; an empty bound is none.
    store.run("top_drivers", star(spark, folder), "1996-01-01", "1996-12-30")
    store.run("top_drivers", star(spark, folder), "", None)
    assert made == ["driver"] * 3
    store.run("top_drivers", star(spark, folder))
    assert made == ["driver"] * 3


def test_changed_file_drops_the_result(spark, folder, made, tmp_path):
    store = ResultStore(spark, f"{tmp_path}/results")
    before = rows(store.run("paid_unpaid", star(spark, folder)))
    half = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_orderkey % 2 = 0").toPandas()
    import pyarrow as pa
    import pyarrow.parquet as pq

    schema = pq.read_schema(f"{folder}/lineitem.parquet")
    pq.write_table(pa.Table.from_pandas(half, schema=schema, preserve_index=False), f"{folder}/lineitem.parquet")
    after = rows(store.run("paid_unpaid", star(spark, folder)))
    assert made == ["time", "time"] and after != before
    assert after == rows(run("paid_unpaid", star(spark, folder)))
    requests = [f"{tmp_path}/results/{r}" for r in os.listdir(f"{tmp_path}/results")]
    assert [len(os.listdir(r)) for r in requests] == [1]


def test_unfinished_result_is_made_again(spark, folder, made, tmp_path):
    store = ResultStore(spark, f"{tmp_path}/results")
    first = rows(store.run("trips_by_status", star(spark, folder), dashboard="overview"))
    for base, _, files in os.walk(f"{tmp_path}/results"):
        if "_SUCCESS" in files:
            os.remove(f"{base}/_SUCCESS")
    assert rows(store.run("trips_by_status", star(spark, folder), dashboard="overview")) == first
    assert made == ["status", "status"]


def test_dashboard_is_stored_report_by_report(spark, folder, made, tmp_path):
    store = ResultStore(spark, f"{tmp_path}/results")
    tables = star(spark, folder)
    store.run("monthly_revenue", tables, "1996-01-01")
    frames = store.run_dashboard("fleet", tables, "1996-01-01")
    assert made.count("time") == 2 and len(made) == 7
    for key in ("monthly_revenue", "top_drivers", "peak_hours"):
        assert rows(frames[key]) == rows(run(key, tables, "1996-01-01"))
    store.run_dashboard("fleet", tables, "1996-01-01")
    assert len(made) == 7
    store.clear()
    store.run("monthly_revenue", tables, "1996-01-01")
    assert len(made) == 8


def test_only_files_have_a_state(spark, folder):
    tables = fixtures.star(spark)
    with pytest.raises(ValueError):
        files_state([tables.trip])
    state = files_state([star(spark, folder).trip])
    assert state == files_state([star(spark, folder).trip])
    os.utime(f"{folder}/orders.parquet", (1, 1))
    assert state != files_state([star(spark, folder).trip])
