import datetime as dt

import pytest

from fleetboard.plans import metric_by_date, series_by_position, two_metrics
from fleetboard.session import checkpoint_dir
from fleetboard.sources import (
    KeySpans,
    by_footers,
    column_ends,
    day_predicates,
    read_csv_inferred,
    read_label_value_csv,
    rows_frame,
)
from fleetboard.sources.jdbc import jdbc_options

VALUES = [
    ("2026-01-05", 12), ("2026-01-12", 19), ("2026-01-18", 15), ("2026-01-25", 22),
    ("2026-02-05", 85), ("2026-02-12", 14), ("2026-02-15", 100), ("2026-02-25", 2232),
]
METRICS = [(1200, 530), (1900, 250), (1500, 1100), (2000, 250), (3500, 560), (3650, 2410)]
DATED = """Date,Revenue,Units
2026-01-05,1900,250
2026-01-14,2000,350
2026-01-22,2508,658
2026-01-23,3056,100
2026-01-23,4000,50"""
QUOTED = '"Month", "Revenue"\n"Jan", 1200\n"Feb", 1900\n"Mar", 2500\n"Apr", 1600'


def day(text):
    return dt.date.fromisoformat(text)


def put(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_literal_rows_in_a_range(spark):
    df = rows_frame(spark, [(day(d), v) for d, v in VALUES], "date date, value int")
    got = metric_by_date(df, "date", "value", "2026-01-01", "2026-01-31").collect()
    assert [tuple(r) for r in got] == [(day(d), v) for d, v in VALUES[:4]]
    assert metric_by_date(df, "date", "value").count() == 8


def test_chosen_metric(spark):
    rows = [(day("2026-01-05"), r, u) for r, u in METRICS]
    df = rows_frame(spark, rows, "date date, revenue int, units int")
    choices = ["revenue", "units"]
    got = two_metrics(df, "date", "revenue", "units", choices, "2026-01-01", "2026-01-31")
    assert [(r["value"], r["second"]) for r in got.collect()] == METRICS
    got = two_metrics(df, "date", "units", "units", choices)
    assert [r["value"] for r in got.collect()] == [u for _, u in METRICS]
    with pytest.raises(ValueError):
        two_metrics(df, "date", "date; drop", "units", choices)


def test_csv_with_inferred_types(spark, tmp_path):
    df = read_csv_inferred(spark, put(tmp_path, DATED))
    assert df.dtypes == [("Date", "date"), ("Revenue", "int"), ("Units", "int")]
    got = series_by_position(df, "2026-01-14", "2026-01-23").collect()
    assert len(got) == 8
    assert tuple(got[0]) == (day("2026-01-14"), "Revenue", 2000.0)
    assert tuple(got[1]) == (day("2026-01-14"), "Units", 350.0)
    for start, end in (("2026-01-22", None), (None, "2026-01-05"), (None, None)):
        assert series_by_position(df, start, end).count() == 10


def test_csv_with_a_given_schema(spark, tmp_path):
    df = read_csv_inferred(spark, put(tmp_path, DATED), "Date string, Revenue double, Units int")
    assert series_by_position(df, "2026-01-23", "2026-01-23").count() == 4


def test_csv_of_labels_and_numbers(spark, tmp_path):
    got = read_label_value_csv(spark, put(tmp_path, QUOTED)).collect()
    assert [tuple(r) for r in got] == [("Jan", 1200.0), ("Feb", 1900.0), ("Mar", 2500.0), ("Apr", 1600.0)]


def test_csv_of_labels_and_odd_cells(spark, tmp_path):
    text = "L,V\n a , 1.5 \n\n   \nb,abc\nc,\nd,2,extra\ne,1e3\n"
    got = read_label_value_csv(spark, put(tmp_path, text)).collect()
    assert [tuple(r) for r in got] == [
        ("a", 1.5), ("b", None), ("c", None), ("d", 2.0), ("e", 1000.0)]


def test_predicates_cover_every_row_once(spark):
    spans = day_predicates("t", day("2026-01-01"), day("2026-01-10"), 3)
    times = [None] + [
        dt.datetime(2025, 12, 25) + dt.timedelta(hours=h) for h in range(0, 24 * 25, 5)
    ]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert sum(df.filter(p).count() for p in spans) == len(times)
    assert len(spans) == 4 + 3
    with pytest.raises(ValueError):
        day_predicates("t", day("2026-01-02"), day("2026-01-01"))


def test_jdbc_options():
    options = jdbc_options("jdbc:mysql://db/fleet", "boat", sessionInitStatement="set x = 1")
    assert options["dbtable"] == "boat" and options["pushDownAggregate"] == "true"
    assert options["sessionInitStatement"] == "set x = 1"
    assert KeySpans("boatid", 1, 1000, 8).options() == {
        "partitionColumn": "boatid", "lowerBound": "1", "upperBound": "1000", "numPartitions": "8"}


def test_shared_folder_is_the_named_one(spark, monkeypatch):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)

    class OnCluster:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = OnCluster()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_ends_come_from_footers(spark, tmp_path):
    from pyspark.sql import functions as F

    path = f"{tmp_path}/t.parquet"
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, cast(id as int)) as a", "id / 7 as b", "date_add(date'2024-01-01', cast(id as int)) as d")
    rows.repartition(3).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    with by_footers(spark):
        plan = spark.read.parquet(path).agg(F.min("a"), F.max("b"), F.count("a"))._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [MIN(a), MAX(b), COUNT(a)]" in plan
        plan = spark.read.parquet(path).filter("b > 3").agg(F.min("a"))._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: []" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    got = {r["column"]: tuple(r)[1:] for r in column_ends(spark, path, ["id", "a", "b"]).collect()}
    assert got == {"id": (0.0, 999.0, 1000), "a": (1.0, 998.0, 666), "b": (0.0, 999 / 7, 1000)}
    some = {r["column"]: tuple(r)[1:] for r in column_ends(spark, path, ["a"], F.col("id") > 900).collect()}
    assert some == {"a": (901.0, 998.0, 66)}


def test_ends_where_footers_cannot_tell(spark, tmp_path):
    rows = [(1.0, None, float("nan"), 1.0), (2.0, None, 5.0, float("inf")), (None, None, -1.0, 2.0)]
    path = f"{tmp_path}/odd.parquet"
    spark.createDataFrame(rows, "a double, b double, c double, d double").coalesce(1).write.parquet(path)
    got = {r["column"]: tuple(r)[1:] for r in column_ends(spark, path, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": (1.0, 2.0, 2), "b": (None, None, 0), "c": (-1.0, 5.0, 3), "d": (1.0, 2.0, 3)}
    none = f"{tmp_path}/none.parquet"
    spark.createDataFrame([], "a double").write.parquet(none)
    assert [tuple(r) for r in column_ends(spark, none, ["a"]).collect()] == [("a", None, None, 0)]
