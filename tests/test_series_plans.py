"""What the plans of the series operators do: shuffles, sorts and reads."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fleetboard.operators import series as S
from fleetboard.operators.series import decimate, segments

from . import brute


def final_plan(df) -> str:
    """The plan as it ran, with its subqueries but without the first guess."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]


def lines(plan: str, *words: str) -> list[str]:
    return [line for line in plan.splitlines() if all(w in line for w in words)]


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('points')}/points.parquet"
    rows = spark.range(6000).selectExpr(
        "if(id % 3 = 0, 'b', 'a') as series", "id * 7 % 6011 as x", "cast(id % 50 as double) as y", "id"
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", ["gap", "rank", "sorted"])
def test_rows_are_shuffled_once(points, name):
    """Every step of an operator reads one and the same shuffle, and nothing was written down."""
    df = {
        "gap": lambda: S.gap_segments(points, gap=3, group_rows=800),
        "rank": lambda: S.time_rank(points, group_rows=800),
        "sorted": lambda: S.is_sorted(points, group_rows=800),
    }[name]()
    plan = final_plan(df)
    shuffles = [x for x in lines(plan, "Exchange hashpartitioning(_range", "REPARTITION_BY_NUM") if "Reused" not in x]
    assert len(shuffles) == 1
    assert lines(plan, "ReusedExchange")
    assert {m for x in lines(plan, "FileScan") for m in re.findall(r"/(\w+\.parquet)", x)} == {"points.parquet"}


def test_min_max_sorts_no_points(points):
    plan = final_plan(S.min_max_decimate(points, 10, 0))
    rows = plan[plan.index("MapInArrow") :]
    assert not lines(rows, "Sort ") and not lines(rows, "Exchange hashpartitioning(series")
    assert len(lines(plan, "FileScan parquet", "points.parquet")) == 1


def test_smallest_step_puts_nothing_in_order(points):
    plan = final_plan(S.smallest_step(points, ["series"]))
    assert not lines(plan, "rangepartitioning") and not lines(plan, "Window")


def test_slices_read_their_surroundings(spark, points):
    """Both ends of every read are bounded if neighbours are near."""
    df = S.range_slice(points, 3000, 3050)
    reads = lines(df._jdf.queryExecution().executedPlan().toString(), "FileScan parquet", "points.parquet")
    for read in reads:
        pushed = re.search(r"PushedFilters: \[(.*?)\]", read).group(1)
        assert "LessThan" in pushed and "GreaterThan" in pushed, read
    ends = [int(x) for read in reads for x in re.findall(r"Than(?:OrEqual)?\(x,(\d+)\)", read)]
    assert min(ends) >= 3000 - 50 and max(ends) <= 3050 + 50


def test_slices_search_on_for_sparse_series(spark):
    rows = [("dense", x, 1.0, x) for x in range(0, 1000)]
    rows += [("sparse", 100, 1.0, 2001), ("sparse", 880, 2.0, 2002), ("far", -900_000, 1.0, 2003), ("far", 900_000, 1.0, 2004)]
    rows += [("old", 10, 1.0, 2005), ("new", 990, 1.0, 2006)]
    df = spark.createDataFrame(rows, "series string, x bigint, y double, id bigint")
    want = set(range(499, 512)) | {2001, 2002, 2003, 2004}
    assert {r["id"] for r in S.range_slice(df, 500, 510).collect()} == want
    # Named series are all that is searched for: "far" is not, so the search ends early.
    named = spark.createDataFrame([("dense",), ("sparse",)], "series string")
    assert {r["id"] for r in S.range_slice(df, 500, 510, series=named).collect()} == want - {2003, 2004}
    assert {r["id"] for r in S.range_slice(df, 500, 500).collect()} == {499, 500, 501, 2001, 2002, 2003, 2004}


def test_slices_at_the_ends_of_the_axis(spark):
    top = 2**63 - 1
    rows = [("s", -top, 1.0, 1), ("s", 0, 1.0, 2), ("s", 5, 1.0, 3), ("s", top, 1.0, 4)]
    df = spark.createDataFrame(rows, "series string, x bigint, y double, id bigint")
    assert {r["id"] for r in S.range_slice(df, -top, top - 1).collect()} == {1, 2, 3, 4}
    assert {r["id"] for r in S.range_slice(df, 1, 4).collect()} == {2, 3}


def convex(n: int) -> list[dict]:
    return [{"series": "s", "x": k, "y": float(k) * k, "id": k} for k in range(n)]


def test_a_convex_series_is_worked_out_in_stretches(spark, monkeypatch):
    """Every point is a corner, and the chain is still cut."""
    rows = convex(4000)
    df = spark.createDataFrame([tuple(p.values()) for p in rows], "series string, x bigint, y double, id bigint")
    seen = []
    plain = decimate.chain_maps
    monkeypatch.setattr(decimate, "chain_maps", lambda schema: seen.append(schema) or plain(schema))
    got = S.lttb_decimate(df, 66, threshold=0, group_rows=500)
    assert {("s", r["id"]) for r in got.collect()} == brute.lttb(rows, 66, 0)
    assert seen
    plan = final_plan(got)
    assert lines(plan, "Exchange hashpartitioning(series", "stretch")


@pytest.mark.parametrize("areas", [0, 3, 4_000_000])
def test_cuts_do_not_change_the_choice(spark, monkeypatch, areas):
    monkeypatch.setattr(decimate, "CUT_AREAS", areas)
    rows = [{"series": s, "x": k, "y": float((k * 37 + len(s)) % 101), "id": k} for s in ("a", "bb") for k in range(600)]
    df = spark.createDataFrame([tuple(p.values()) for p in rows], "series string, x bigint, y double, id bigint")
    assert {(r["series"], r["id"]) for r in S.lttb_decimate(df, 40, threshold=0).collect()} == brute.lttb(rows, 40, 0)


def test_visible_points_decide_the_decimation(spark):
    rows = [("s", k, float(k * 31 % 17), k) for k in range(1000)]
    df = spark.createDataFrame(rows, "series string, x bigint, y double, id bigint")
    # Forty points and their neighbours are few enough to be drawn whole.
    assert {r["id"] for r in S.decimate_visible(df, 100, 139, 20).collect()} == set(range(99, 141))
    shown = [{"series": "s", "x": k, "y": float(k * 31 % 17), "id": k} for k in range(99, 601)]
    got = {("s", r["id"]) for r in S.decimate_visible(df, 100, 599, 20).collect()}
    assert got == brute.min_max(shown, 20, 80)
    got = {("s", r["id"]) for r in S.decimate_visible(df, 100, 599, 20, samples=20, largest=True).collect()}
    assert got == brute.lttb(shown, 20, 80)


@pytest.mark.parametrize("kind", ["double", "date", "timestamp_ntz", "decimal(12,3)"])
def test_smallest_step_of_any_axis(spark, kind):
    step = {"double": "x * 1.5D", "date": "date_add(date'2024-01-01', cast(x as int))",
            "timestamp_ntz": "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, x)", "decimal(12,3)": "cast(x as decimal(12,3))"}[kind]
    values = [1, 1, 40, 90, 93, 300, 5000, 5002, 9000, None]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").selectExpr("v as x").selectExpr(f"{step} as x")
    got = S.smallest_step(df).first()["step"]
    assert df.schema["x"].dataType.simpleString() == kind
    assert {"double": 3.0, "date": 2, "timestamp_ntz": 2, "decimal(12,3)": 2}[kind] == (
        got.total_seconds() if kind == "timestamp_ntz" else got.days if kind == "date" and hasattr(got, "days") else float(got)
    )
    assert S.smallest_step(df.filter("x is null")).first()["step"] is None


def test_smallest_step_with_dense_clusters(spark):
    """Points a thousand times closer in one place than in the rest."""
    rows = [(float(k) * 10,) for k in range(3000)] + [(12345.0 + k * 0.01 + (0.003 if k == 700 else 0.0),) for k in range(2000)]
    df = spark.createDataFrame(rows, "x double")
    xs = sorted({r[0] for r in rows})
    assert S.smallest_step(df).first()["step"] == min(b - a for a, b in zip(xs, xs[1:], strict=False))


def test_searches_are_few(spark, monkeypatch):
    """A series without neighbours ends the search after the bounded ones and the rest."""
    calls = []
    plain = segments._found
    monkeypatch.setattr(segments, "_found", lambda *a: calls.append(1) or plain(*a))
    df = spark.range(100).select(F.lit("s").alias("series"), F.col("id").alias("x"), F.lit(1.0).alias("y"), "id")
    assert S.range_slice(df, 98, 120).count() == 3
    assert len(calls) == segments.SEARCHES + 1
