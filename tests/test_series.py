import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetboard.operators import series as S
from fleetboard.operators.ordered import in_order

from . import brute

SCHEMA = "series string, x bigint, y double, id bigint"
# One plain window per group, and groups cut into ranges of a few rows.
SIZES = [1_000_000, 7]


def frame(spark, points):
    return spark.createDataFrame([(p["series"], p["x"], p["y"], p["id"]) for p in points], SCHEMA)


def made(seed, sizes, y=None, x=None, nulls=0.0):
    """Points with one hot series, repeated x, repeated y and a NULL series."""
    rnd = random.Random(seed)
    points = []
    for series, n in sizes.items():
        for _ in range(n):
            points.append(
                {
                    "series": series,
                    "x": (x or (lambda r: r.randrange(3 * n)))(rnd),
                    "y": None if rnd.random() < nulls else (y or (lambda r: r.randrange(50) / 4))(rnd),
                    "id": len(points),
                }
            )
    rnd.shuffle(points)
    return points


MIXED = {"hot": 400, "b": 60, None: 45, "one": 1}


def ids(df):
    return {(r["series"], r["id"]) for r in df.collect()}


# -- the ordered helper -------------------------------------------------------------------


@pytest.mark.parametrize("group_rows", SIZES)
@pytest.mark.parametrize("keys", [["series"], []])
def test_ordered_columns_match_plain_windows(spark, group_rows, keys):
    from pyspark.sql import Window

    df = frame(spark, made(3, MIXED, nulls=0.4))
    w = Window.partitionBy(*keys).orderBy("x", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    onward = w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select(
        "id",
        (F.row_number().over(w) - 1).alias("n"),
        F.lag("y").over(w).alias("before"),
        F.lead("y").over(w).alias("after"),
        F.sum("y").over(upto).alias("total"),
        F.last("y", True).over(upto).alias("known"),
        F.first("y", True).over(onward).alias("coming"),
        F.first("y", True).over(upto).alias("start"),
    )
    ordered = in_order(df, keys, ["x", "id"], group_rows)
    assert ordered.split == (group_rows == 7)
    got = (
        ordered.number("n")
        .neighbour({"before": "y"})
        .neighbour({"after": "y"}, back=False)
        .running_sum("total", F.col("y"))
        .last_known("known", F.col("y"))
        .last_known("coming", F.col("y"), back=False)
        .first_known("start", F.col("y"))
        .rows()
    )
    assert _as_dict(got.select(*want.columns)) == _as_dict(want)


def _as_dict(df):
    return {r["id"]: tuple(r) for r in df.collect()}


# -- decimation -------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("width, threshold", [(5, 0), (12, None), (3, 50)])
def test_min_max_keeps_what_the_rule_keeps(spark, seed, width, threshold):
    points = made(seed, MIXED, nulls=0.1)
    got = S.min_max_decimate(frame(spark, points), width, threshold)
    limit = 4 * width if threshold is None else threshold
    assert ids(got) == brute.min_max(points, width, limit)
    assert got.count() == len(brute.min_max(points, width, limit))


def test_min_max_of_flat_and_single_x(spark):
    flat = [{"series": "s", "x": k, "y": 1.0, "id": k} for k in range(100)]
    assert ids(S.min_max_decimate(frame(spark, flat), 4, 0)) == brute.min_max(flat, 4, 0)
    same = [{"series": "s", "x": 5, "y": float(k), "id": k} for k in range(100)]
    assert ids(S.min_max_decimate(frame(spark, same), 4, 0)) == {("s", 0)}


@pytest.mark.parametrize("group_rows", SIZES)
@pytest.mark.parametrize("samples", [1, 2, 3, 10, 37, 60])
def test_lttb_chooses_what_the_rule_chooses(spark, group_rows, samples):
    points = made(samples, MIXED, y=lambda r: r.random() * 100)
    got = S.lttb_decimate(frame(spark, points), samples, threshold=0, group_rows=group_rows)
    want = brute.lttb(points, samples, 0)
    assert ids(got) == want
    assert got.count() == len(want)


@pytest.mark.parametrize(
    "shape",
    [
        lambda k: float(k * k % 97),
        lambda k: float(k * k),  # every point is a hull corner
        lambda k: float(-k * k),
        lambda k: 4.0,  # every triangle is empty
        lambda k: float(k % 2),
    ],
)
def test_lttb_shapes_in_small_batches(spark, shape):
    points = [{"series": "s", "x": k, "y": shape(k), "id": k} for k in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = S.lttb_decimate(frame(spark, points), 20, threshold=0, group_rows=100)
        assert ids(got) == brute.lttb(points, 20, 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lttb_returns_short_series_whole(spark):
    points = made(1, {"a": 30, "b": 200})
    got = S.lttb_decimate(frame(spark, points), 10, samples=15)
    sizes = {r["series"]: r["count"] for r in got.groupBy("series").count().collect()}
    assert sizes == {"a": 30, "b": 15}


# -- stacks, shares ---------------------------------------------------------------------------


@pytest.mark.parametrize("group_rows", SIZES)
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.lists(st.lists(st.integers(-3, 3), min_size=12, max_size=12), min_size=2, max_size=4))
def test_stack_tops(spark, group_rows, data):
    rows = [
        ("st", f"s{k}", k, x, float(v), k)
        for x, values in enumerate(data)
        for k, v in enumerate(values)
    ]
    df = spark.createDataFrame(
        rows, "stack string, series string, series_order int, x int, y double, id int"
    )
    got = {(r["x"], r["series_order"]): r for r in S.stack_series(df, group_rows).collect()}
    for x, values in enumerate(data):
        for k, top in enumerate(brute.stack_tops([float(v) for v in values])):
            assert got[x, k]["top"] == top
            assert got[x, k]["base"] == top - values[k]


def test_stack_skips_null_and_takes_the_last_of_repeated_x(spark):
    df = spark.createDataFrame(
        [("a", "s0", 0, 1, 2.0, 1), ("a", "s0", 0, 1, 5.0, 2), ("a", "s1", 1, 1, None, 3),
         ("a", "s2", 2, 1, 1.0, 4), ("b", "s3", 3, 1, 7.0, 5)],
        "stack string, series string, series_order int, x int, y double, id int",
    )
    got = {r["id"]: r["top"] for r in S.stack_series(df).collect()}
    assert got == {1: 2.0, 2: 5.0, 4: 6.0, 5: 7.0}


def test_shares(spark):
    df = spark.createDataFrame(
        [("s", "a", -3.0), ("s", "b", 1.0), ("s", "c", None), ("s", "d", 4.0), ("z", "a", 0.0),
         (None, "a", 2.0)],
        "series string, label string, y double",
    )
    got = {(r["series"], r["label"]): r["share"] for r in S.share_of_total(df).collect()}
    assert got == {("s", "a"): 0.375, ("s", "b"): 0.125, ("s", "c"): 0.0, ("s", "d"): 0.5,
                   ("z", "a"): 0.0, (None, "a"): 1.0}
    less = {r["label"]: r["share"] for r in S.share_of_total(df, ["d"]).filter("series = 's'").collect()}
    assert less == {"a": 0.75, "b": 0.25, "c": 0.0}


# -- extents ------------------------------------------------------------------------------------


def ends(df):
    r = df.first()
    return r["lo"], r["hi"]


def test_extents(spark):
    df = frame(spark, [{"series": "s", "x": k, "y": float(y), "id": k}
                       for k, y in enumerate([5, -2, 9, 4])] +
               [{"series": "t", "x": 0, "y": 100.0, "id": 9},
                {"series": "s", "x": 5, "y": float("inf"), "id": 10},
                {"series": "s", "x": 6, "y": None, "id": 11}])
    assert ends(S.extents(df, hidden=["t"])) == (-2.0, 9.0)
    assert ends(S.extents(df, keys=())) == (-2.0, 100.0)
    assert ends(S.extents(df, hidden=["t"], other=(2, None))) == (4.0, 9.0)
    assert ends(S.extents(df, hidden=["t"], user=(0, None))) == (0.0, 9.0)
    assert ends(S.extents(df, hidden=["t"], suggested=(-10, 5))) == (-10.0, 9.0)
    assert ends(S.extents(df, hidden=["t"], user=(None, -5))) == (-5.0, -5.0)
    assert ends(S.extents(df, hidden=["t"], user=(20, None))) == (20.0, 20.0)
    assert ends(S.extents(df, keys=(), other=(50, None))) == (None, None)
    assert ends(S.extents(df, keys=(), other=(50, None), user=(3, None))) == (3.0, 3.0)


@pytest.mark.parametrize(
    "lo, hi, args, want",
    [
        (None, None, {}, (0.0, 1.0)),
        (2.0, 8.0, {"begin_at_zero": True}, (0.0, 8.0)),
        (-8.0, -2.0, {"begin_at_zero": True}, (-8.0, 0.0)),
        (-2.0, 8.0, {"begin_at_zero": True}, (-2.0, 8.0)),
        (2.0, 8.0, {"begin_at_zero": True, "user": (2.0, None)}, (2.0, 8.0)),
        (20.0, 20.0, {}, (19.0, 21.0)),
        (0.0, 0.0, {}, (-1.0, 1.0)),
        (0.0, 0.0, {"begin_at_zero": True}, (0.0, 1.0)),
        (20.0, 20.0, {"user": (20.0, None)}, (20.0, 21.0)),
        (0.0, 10.0, {"grace": 2}, (-2.0, 12.0)),
        (0.0, 10.0, {"grace": "10%"}, (-0.5, 10.5)),
        (0.0, 10.0, {"grace": "10%", "begin_at_zero": True}, (0.0, 10.5)),
    ],
)
def test_adjusted_extents(spark, lo, hi, args, want):
    df = spark.createDataFrame([(lo, hi)], "lo double, hi double")
    assert ends(S.adjust_extents(df, **args)) == want


# -- runs and slices -------------------------------------------------------------------------------


@pytest.mark.parametrize("group_rows", SIZES)
@pytest.mark.parametrize("gap", [None, 4])
def test_segments(spark, group_rows, gap):
    points = made(8, MIXED, nulls=0.3)
    got = S.gap_segments(frame(spark, points), gap, group_rows=group_rows).collect()
    want = {}
    for ps in brute.by_series(points).values():
        want.update(brute.segments(ps, gap))
    assert {r["id"]: r["segment"] for r in got} == want
    assert len(got) == len(want)


def test_segments_spanned(spark):
    points = made(8, MIXED, nulls=0.3)
    got = S.gap_segments(frame(spark, points), span_gaps=True).collect()
    assert len(got) == sum(p["y"] is not None for p in points)
    assert {r["segment"] for r in got} == {0}


@pytest.mark.parametrize("lo, hi", [(10, 50), (-5, 2), (5000, 6000), (-9, -3), (31, 31), (0, 9999)])
def test_range_slice(spark, lo, hi):
    points = made(5, MIXED)
    want = set()
    for series, ps in brute.by_series(points).items():
        for k, p in enumerate(ps):
            after = ps[k + 1]["x"] if k + 1 < len(ps) else None
            before = ps[k - 1]["x"] if k else None
            if (
                lo <= p["x"] <= hi
                or p["x"] < lo and after is not None and after >= lo
                or p["x"] > hi and before is not None and before <= hi
            ):
                want.add((series, p["id"]))
    got = S.range_slice(frame(spark, points), lo, hi)
    assert ids(got) == want and got.count() == len(want)


def test_range_slice_across_missing_values(spark):
    points = [
        ("a", 1, 5.0, 1), ("a", 3, None, 2), ("a", 5, 6.0, 3), ("a", 8, float("nan"), 4),
        ("a", 9, 7.0, 5), ("b", 2, 1.0, 6), ("b", 2, 2.0, 7), ("b", 9, 3.0, 8), ("c", 1, 1.0, 9),
        (None, 2, 1.0, 10), (None, 7, None, 11), (None, 9, 4.0, 12),
    ]
    df = spark.createDataFrame(points, "series string, x bigint, y double, id bigint")
    plain = {r["id"] for r in S.range_slice(df, 4, 6).collect()}
    assert plain == {2, 3, 4, 7, 8, 10, 11}
    spanned = {r["id"] for r in S.range_slice(df, 4, 6, span_gaps=True).collect()}
    assert spanned == {1, 3, 5, 7, 8, 10, 12}
    empty = df.filter("id < 0")
    assert S.range_slice(empty, 4, 6, span_gaps=True).count() == 0


def test_range_slice_bounds_reach_every_scan(spark, sf_dir):
    from checks.series import timed, week
    from pyspark.sql import functions as F

    df = S.range_slice(timed(spark, sf_dir, "event_type", F.col("value")), *week())
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "ReadSchema" in line]
    scans = [line for line in scans if "events.parquet" in line]
    assert scans
    assert all("LessThan" in line or "GreaterThan" in line for line in scans)


def test_time_rank_between_ends(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 3), ("a", 5), ("a", 9), ("b", 4), ("b", 4), ("c", 9), ("d", None)],
        "series string, x bigint",
    )
    got = {tuple(r) for r in S.time_rank(df, ends=(2, 9)).collect()}
    assert got == {("a", 3, 0.0), ("a", 5, 0.5), ("a", 9, 1.0)} | {
        (key, x, at) for key in "bcd" for x, at in ((2, 0.0), (9, 1.0))
    }


@pytest.mark.parametrize("group_rows", SIZES)
def test_is_sorted(spark, group_rows):
    rows = [("up", k, 0.0, k) for k in range(40)] + [("down", 40 - k, 0.0, k) for k in range(40)]
    rows += [("flat", 3, 0.0, k) for k in range(9)] + [("hole", None if k == 4 else k, 0.0, k) for k in range(9)]
    rows += [("late", k if k < 39 else 0, 0.0, k) for k in range(40)]
    got = S.is_sorted(spark.createDataFrame(rows, SCHEMA), group_rows=group_rows).collect()
    assert {r["series"]: r["sorted"] for r in got} == {
        "up": True, "down": False, "flat": True, "hole": False, "late": False}


# -- times ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("group_rows", SIZES)
def test_time_rank_and_positions(spark, group_rows):
    points = made(2, MIXED)
    df = frame(spark, points)
    ranks = S.time_rank(df, group_rows=group_rows)
    want = {}
    for series, ps in brute.by_series(points).items():
        xs = sorted({p["x"] for p in ps})
        for i, x in enumerate(xs):
            want[series, x] = i / (len(xs) - 1) if len(xs) > 1 else 0.0
    assert {(r["series"], r["x"]): r["position"] for r in ranks.collect()} == want

    asked = [(s, x) for s in ("hot", "b", None) for x in range(-5, 1300, 11)]
    queries = spark.createDataFrame(asked, "series string, x bigint")
    got = S.time_positions(ranks, queries, group_rows=group_rows).collect()
    assert len(got) == len(asked)
    for r in got:
        known = sorted((x, p) for (s, x), p in want.items() if s == r["series"])
        lo = max([k for k in known if k[0] <= r["x"]], default=None)
        hi = min([k for k in known if k[0] >= r["x"]], default=None)
        if lo is None or hi is None:
            lo, hi = known[0], known[-1]
        part = (r["x"] - lo[0]) / (hi[0] - lo[0]) if hi[0] != lo[0] else 0.0
        assert r["position"] == pytest.approx(lo[1] + part * (hi[1] - lo[1]))


def test_smallest_step(spark):
    rows = [("a", x, 0.0, x) for x in range(0, 400, 10)] + [("a", 213, 0.0, 999), ("b", 1, 0.0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.smallest_step(df, ["series"]).collect()
    assert {r["series"]: r["step"] for r in got} == {"a": 3, "b": None}
    assert S.smallest_step(df, ()).first()["step"] == 1


def test_distinct_times_in_order(spark):
    df = frame(spark, made(2, MIXED))
    xs = [r["x"] for r in S.distinct_times(df).collect()]
    assert xs == sorted(set(xs))


@pytest.mark.parametrize(
    "unit, start, want",
    [
        ("week", 1, "2026-01-12 00:00:00"),
        ("week", 7, "2026-01-11 00:00:00"),
        ("week", 4, "2026-01-15 00:00:00"),
        ("month", 1, "2026-01-01 00:00:00"),
        ("quarter", 1, "2026-01-01 00:00:00"),
        ("minute", 1, "2026-01-15 13:14:00"),
    ],
)
def test_time_bucket(spark, unit, start, want):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 15, 13, 14, 15),)], "t timestamp_ntz")
    got = df.select(S.time_bucket(F.col("t"), unit, start).alias("b")).first()["b"]
    assert str(got) == want


def test_time_bucket_unknown_unit():
    with pytest.raises(ValueError):
        S.time_bucket(None, "fortnight")


def test_calendar_fill(spark):
    rows = [("a", dt.datetime(2026, 1, 1, 5)), ("a", dt.datetime(2026, 1, 4, 1)),
            ("b", dt.datetime(2026, 1, 2)), ("b", None)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    got = S.calendar_fill(df, "t", "day", {"n": F.count("*")}, ["k"]).orderBy("k", "bucket").collect()
    assert [(r["k"], r["bucket"].day, r["n"]) for r in got] == [
        ("a", 1, 1), ("a", 2, None), ("a", 3, None), ("a", 4, 1), ("b", 2, 1)]


def test_calendar_spine_steps_and_guard(spark):
    rows = [(dt.datetime(2020, 1, 31),), (dt.datetime(2026, 1, 1),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    years = [r["bucket"].year for r in S.calendar_spine(df, "t", "year", step=2).collect()]
    assert years == [2020, 2022, 2024, 2026]
    with pytest.raises(Exception, match="too many"):
        S.calendar_spine(df, "t", "minute", max_steps=100_000).count()
    days = (dt.datetime(2026, 1, 1) - dt.datetime(2020, 1, 31)).days
    minutes = S.calendar_spine(df, "t", "minute")
    assert minutes.count() == minutes.distinct().count() == 24 * 60 * days + 1
    assert S.calendar_spine(df, "t", "hour").count() == 24 * (dt.datetime(2026, 1, 1) - dt.datetime(2020, 1, 31)).days + 1


# -- labels and nested data -----------------------------------------------------------------------------


@pytest.mark.parametrize("group_rows", SIZES)
def test_label_index(spark, group_rows):
    rnd = random.Random(4)
    labels = [f"l{rnd.randrange(40)}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, label string")
    got = S.label_index(df, "label", "i", group_rows).collect()
    order = list(dict.fromkeys(labels))
    assert {r["label"]: r["index"] for r in got} == {t: k for k, t in enumerate(order)}


def test_label_positions(spark):
    axis = spark.createDataFrame(
        [("a", 0), ("b", 1), ("a", 2), ("c", 3)], "label string, i bigint")
    points = spark.createDataFrame(
        [("b", 0), ("a", 1), ("z", 2), ("c", 3), ("y", 4), ("z", 5), (None, 6)],
        "label string, i bigint")
    got = {r["i"]: r["position"] for r in S.label_positions(points, axis).collect()}
    assert got == {0: 1, 1: 1, 2: 4, 3: 3, 4: 5, 5: 4, 6: None}


def test_number_labels(spark):
    axis = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "label int, i bigint")
    points = spark.createDataFrame([(30, 0), (25, 1), (99, 7)], "label int, i bigint")
    got = {r["i"]: r["position"] for r in S.label_positions(points, axis).collect()}
    assert got == {0: 2, 1: 1, 7: 2}


def test_nested_data(spark):
    df = spark.createDataFrame(
        [(1, ["a", "b", "c"], [1.0, 2.0], [[1.0, 2.0], [3.0, 4.0, 5.0]], {"k": 7.0})],
        "n int, labels array<string>, vals array<double>, pairs array<array<double>>, "
        "m map<string,double>",
    )
    assert [tuple(r) for r in S.arrays_to_points(df, ["n"], "labels", "vals").collect()] == [
        (1, 0, "a", 1.0), (1, 1, "b", 2.0), (1, 2, "c", None)]
    assert [tuple(r) for r in S.pairs_to_points(df, ["n"], "pairs").collect()] == [
        (1, 0, 1.0, 2.0, None), (1, 1, 3.0, 4.0, 5.0)]
    assert [tuple(r) for r in S.map_to_points(df, ["n"], "m").collect()] == [(1, "k", 7.0)]
    obj = spark.createDataFrame(
        [(1, [{"p": {"v": 5}, "q": 6}])], "n int, o array<struct<p:struct<v:int>,q:int>>")
    assert [tuple(r) for r in S.objects_to_points(obj, ["n"], "o", "p.v", "q").collect()] == [(1, 0, 5, 6)]


def test_value_rules(spark):
    df = spark.createDataFrame([(3.0, -5.0), (2.0, 7.0), (-4.0, 4.0)], "s double, e double")
    got = df.select(*[c.alias(n) for n, c in S.range_values(F.col("s"), F.col("e")).items()]).collect()
    assert [tuple(r) for r in got] == [(-5.0, 3.0, 3.0, -5.0), (2.0, 7.0, 2.0, 7.0), (-4.0, 4.0, -4.0, 4.0)]
    ys = spark.createDataFrame([(1.5,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "y double")
    assert [r[0] for r in ys.select(S.positive_only(F.col("y"))).collect()] == [1.5] + [None] * 5


# -- rows that once went wrong -------------------------------------------------------------------------


def test_lttb_of_columns_declared_without_nulls(spark):
    df = spark.range(2000).select(
        F.lit("s").alias("series"), F.col("id").alias("x"), (F.col("id") * 7 % 101).cast("double").alias("y"), "id"
    )
    assert not df.schema["series"].nullable
    assert S.lttb_decimate(df, 20, threshold=100).count() == 20


def test_min_max_passes_over_nan(spark):
    points = [("s", i, float(i % 10), i) for i in range(100)]
    points[55] = ("s", 55, float("nan"), 55)
    points[57] = ("s", 57, 99.0, 57)
    kept = {r["id"] for r in S.min_max_decimate(spark.createDataFrame(points, SCHEMA), 4, 10).collect()}
    assert 57 in kept and 55 not in kept


def test_extents_keep_a_series_without_a_counted_point(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 0), ("b", -1, 7.0, 1), ("c", 1, None, 2)], SCHEMA)
    got = {r["series"]: (r["lo"], r["hi"]) for r in S.extents(df, other=(0, None)).collect()}
    assert got == {"a": (5.0, 5.0), "b": (None, None), "c": (None, None)}
    got = {r["series"]: (r["lo"], r["hi"]) for r in S.extents(df, other=(0, None), user=(2, None)).collect()}
    assert got == {"a": (2.0, 5.0), "b": (2.0, 2.0), "c": (2.0, 2.0)}
    got = {r["series"]: (r["lo"], r["hi"]) for r in S.adjust_extents(S.extents(df, other=(0, None))).collect()}
    assert got["b"] == (0.0, 1.0)


def test_positions_of_null_times_and_unknown_keys(spark):
    ranks = S.time_rank(spark.createDataFrame([("a", 0), ("a", 10)], "series string, x bigint"))
    asked = spark.createDataFrame([("a", 5), ("a", None), ("z", 3)], "series string, x bigint")
    got = {(r["series"], r["x"]): r["position"] for r in S.time_positions(ranks, asked).collect()}
    assert got == {("a", 5): 0.5, ("a", None): None, ("z", 3): None}


def test_stacking_keeps_every_point(spark):
    rows = [("k", "a", 0, 1, 5.0, 1), ("k", "a", 0, 1, -2.0, 2), ("k", "b", 1, 1, 3.0, 3), ("k", "b", 1, 1, -1.0, 4)]
    df = spark.createDataFrame(rows, "stack string, series string, series_order int, x bigint, y double, id bigint")
    got = {r["id"]: r["top"] for r in S.stack_series(df).collect()}
    assert got == {1: 5.0, 2: -2.0, 3: 3.0, 4: -3.0}
    got = {r["id"]: r["top"] for r in S.stack_series(df, single=True).collect()}
    assert got == {1: 5.0, 2: -2.0, 3: 1.0, 4: -3.0}
