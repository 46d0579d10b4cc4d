"""Series queries over events, orders and lineitem, and their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetboard.operators import series as S
from fleetboard.operators.filters import visible

from .adapter import table

QUERIES = {}
SQL = {}

WIDTH = 50


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


def event_points(spark, folder):
    """Event values over time, one series per type."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_type").alias("series"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("x"),
        F.col("value").alias("y"),
        F.col("event_id").alias("id"),
    )


def user_points(spark, folder):
    """Event values over time, one series per user."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("user_id").alias("series"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("x"),
        # Zero values stand for missing ones, so there are gaps of both kinds.
        F.when(F.col("value") >= 20, F.col("value")).alias("y"),
        F.col("event_id").alias("id"),
    )


def order_points(spark, folder):
    """Order values over time, one series per status."""
    orders = table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderstatus").alias("series"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("x"),
        F.col("o_totalprice").alias("y"),
        F.col("o_orderkey").alias("id"),
    )


def timed(spark, folder, series, y):
    """Event values over the time column itself."""
    events = table(spark, folder, "events")
    return events.select(
        F.col(series).alias("series"), F.col("ts").alias("x"), y.alias("y"),
        F.col("event_id").alias("id"),
    )


def week():
    """Both ends of one week."""
    return [F.to_timestamp_ntz(F.lit(day)) for day in ("2024-01-08 00:00:00", "2024-01-15 00:00:00")]


EVENTS = """events_p as (
  select event_type as series, epoch_us(ts) as x, value as y, event_id as id from events)"""
USERS = """users_p as (
  select user_id as series, epoch_us(ts) as x, case when value >= 20 then value end as y,
    event_id as id from events)"""
ORDERS = """orders_p as (
  select o_orderstatus as series, epoch_us(o_orderdate) as x, o_totalprice as y,
    o_orderkey as id from orders)"""


# -- decimation ---------------------------------------------------------------------


@query(f"""
with {EVENTS},
r as (select series, min(x) as x0, max(x) as x1, count(*) as n from events_p group by 1),
b as (select e.*, r.n, cast(floor((e.x - r.x0) / (r.x1 - r.x0) * {WIDTH}) as int) as b
      from events_p e join r on e.series = r.series),
k as (select *, row_number() over (partition by series, b order by x, id) as a1,
        row_number() over (partition by series, b order by x desc, id desc) as a2,
        row_number() over (partition by series, b order by y, x, id) as a3,
        row_number() over (partition by series, b order by y desc, x, id) as a4 from b)
select series, x, y, id from k
where n <= {4 * WIDTH} or a1 = 1 or (b < {WIDTH} and (a2 = 1 or a3 = 1 or a4 = 1))""")
def minmax_decimate(spark, folder):
    return S.min_max_decimate(event_points(spark, folder), WIDTH)


@query(f"""
with recursive {EVENTS},
s as (select series, count(*) as n, (count(*) - 2) / cast({WIDTH - 2} as double) as r
      from events_p group by 1),
p as (select e.*, s.n, s.r, row_number() over (partition by e.series order by x, id) - 1 as i
      from events_p e join s on e.series = s.series),
spans as (select s.series, c.c, cast(floor(c.c * r) as bigint) + 1 as lo,
            least(cast(floor((c.c + 1) * r) as bigint) + 1, n) as hi
          from s, (select unnest(range({WIDTH - 1})) as c) c),
b as (select p.series, p.x, p.y, p.id, p.i, spans.c
      from p join spans on p.series = spans.series and p.i >= spans.lo and p.i < spans.hi),
m as (select series, c - 1 as c, avg(x) as nx, avg(y) as ny from b group by series, c),
q as (select b.series, b.x, b.y, b.id, b.i, b.c, m.nx, m.ny
      from b join m on b.series = m.series and b.c = m.c where b.c <= {WIDTH - 3}),
w(series, c, pick) as (
  select series, -1, {{'x': x, 'y': y, 'id': id}} from p where i = 0
  union all
  select q.series, q.c, arg_max({{'x': q.x, 'y': q.y, 'id': q.id}},
    {{'a': abs((w.pick.x - q.nx) * (q.y - w.pick.y) - (w.pick.x - q.x) * (q.ny - w.pick.y)),
       'i': -q.i}})
  from w join q on q.series = w.series and q.c = w.c + 1 group by q.series, q.c)
select w.series, pick.x as x, pick.y as y, pick.id as id
from w join s on w.series = s.series where s.n > {4 * WIDTH}
union all
select series, x, y, id from p where n <= {4 * WIDTH} or i = n - 1""")
def lttb_decimate(spark, folder):
    return S.lttb_decimate(event_points(spark, folder), WIDTH)


NAN_EVENTS = EVENTS.replace("value as y", "case when value < 60 then value end as y")


@query(
    SQL["minmax_decimate"]
    .replace(EVENTS, NAN_EVENTS)
    .replace("select series, x, y, id from k", "select series, x, coalesce(y, -1) as y, id from k")
    .replace("a3 = 1 or a4 = 1", "(y is not null and (a3 = 1 or a4 = 1))")
)
def minmax_nan(spark, folder):
    """High values are NaN, which is no extreme; shown as -1 where such a point is kept."""
    y = F.when(F.col("y") < 60, F.col("y")).otherwise(F.lit(float("nan")))
    kept = S.min_max_decimate(event_points(spark, folder).withColumn("y", y), WIDTH)
    return kept.withColumn("y", F.when(F.isnan("y"), -1.0).otherwise(F.col("y")))


@query(SQL["lttb_decimate"].replace("epoch_us(ts) as x", "epoch_us(ts) + 1 as x").replace("value as y", "coalesce(value, 0) as y"))
def lttb_computed(spark, folder):
    """Columns that are computed and so declared without NULLs."""
    points = event_points(spark, folder)
    solid = points.select(
        F.coalesce("series", F.lit("")).alias("series"),
        (F.coalesce("x", F.lit(0)) + 1).alias("x"),
        F.coalesce("y", F.lit(0.0)).alias("y"),
        F.coalesce("id", F.lit(0)).cast("bigint").alias("id"),
    )
    return S.lttb_decimate(solid, WIDTH)


# -- stacks and shares --------------------------------------------------------------


@query("""
with m as (
  select strftime(o_orderdate, '%Y-%m') as x, o_orderstatus as series,
    cast(sum(cast(round((o_totalprice - 150000) * 100) as bigint)) as bigint) as y
  from orders group by 1, 2),
o as (select *, cast(case series when 'F' then 0 when 'O' then 1 else 2 end as int) as k from m)
select x, series, k as series_order, cast(y as double) as y,
  cast(sum(y) over w as double) as top, cast(sum(y) over w - y as double) as base
from o where y <> 0
window w as (partition by x, sign(y) order by k rows unbounded preceding)""")
def stacked_series(spark, folder):
    """Order value above or below 150,000, by month and status."""
    orders = table(spark, folder, "orders")
    cents = F.round((F.col("o_totalprice") - 150000) * 100).cast("bigint")
    monthly = orders.groupBy(
        F.date_format("o_orderdate", "yyyy-MM").alias("x"), F.col("o_orderstatus").alias("series")
    ).agg(F.sum(cents).cast("double").alias("y"))
    place = F.when(F.col("series") == "F", 0).when(F.col("series") == "O", 1).otherwise(2)
    points = monthly.select(
        F.lit("all").alias("stack"), "series", place.alias("series_order"), "x", "y",
        F.lit(0).alias("id"),
    )
    return S.stack_series(points).filter(F.col("y") != 0).drop("stack", "id")


ZERO_MONTHS = """
with m as (
  select strftime(o_orderdate, '%Y-%m') as x, cast(month(o_orderdate) as int) as n, o_orderstatus as series,
    cast(sum(cast(round((o_totalprice - 150000) * 100) as bigint)) as bigint) as y
  from orders group by 1, 2, 3),
k as (select *, cast(case series when 'F' then 0 when 'O' then 1 else 2 end as int) as k from m),
o as (select x, series, k, case when (n + k) % 3 = 0 then 0 else y end as y from k)"""


def _zero_months(spark, folder):
    """Monthly order values of the statuses, of which every third is 0."""
    orders = table(spark, folder, "orders")
    cents = F.round((F.col("o_totalprice") - 150000) * 100).cast("bigint")
    monthly = orders.groupBy(
        F.date_format("o_orderdate", "yyyy-MM").alias("x"), F.month("o_orderdate").alias("n"),
        F.col("o_orderstatus").alias("series"),
    ).agg(F.sum(cents).alias("y"))
    place = F.when(F.col("series") == "F", 0).when(F.col("series") == "O", 1).otherwise(2)
    return monthly.select(
        F.lit("all").alias("stack"), "series", place.alias("series_order"), "x",
        F.when((F.col("n") + place) % 3 == 0, 0).otherwise(F.col("y")).cast("double").alias("y"),
        F.lit(0).alias("id"),
    )


@query(ZERO_MONTHS + """,
s as (
  select o.*, (select arg_min(sign(p.y), p.k) from o p where p.x = o.x and p.k < o.k and p.y <> 0) as side from o)
select x, series, k as series_order, cast(y as double) as y,
  cast(coalesce((select sum(p.y) from s p where p.x = s.x and p.k < s.k
    and sign(p.y) = case when s.y <> 0 then sign(s.y) else s.side end), 0) as double) as base,
  cast(coalesce((select sum(p.y) from s p where p.x = s.x and p.k < s.k
    and sign(p.y) = case when s.y <> 0 then sign(s.y) else s.side end), 0) + y as double) as top
from s""")
def stacked_zeros(spark, folder):
    """A zero sits on the pile of the first value below it."""
    return S.stack_series(_zero_months(spark, folder)).drop("stack", "id")


@query(ZERO_MONTHS + """
select x, series, k as series_order, cast(y as double) as y,
  cast(sum(y) over w - y as double) as base, cast(sum(y) over w as double) as top
from o window w as (partition by x order by k rows unbounded preceding)""")
def stacked_single(spark, folder):
    """All values on one pile, whatever their sign."""
    return S.stack_series(_zero_months(spark, folder), single=True).drop("stack", "id")


SHARE = """
with m as (
  select o_orderstatus as series, o_orderpriority as label,
    cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as c
  from orders {where} group by 1, 2)
select series, label, cast(c as double) as y,
  round(cast(c as double) / cast(sum(c) over (partition by series) as double), 6) as share
from m"""


def _order_shares(spark, folder, hidden=None):
    orders = table(spark, folder, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    points = orders.groupBy(
        F.col("o_orderstatus").alias("series"), F.col("o_orderpriority").alias("label")
    ).agg(F.sum(cents).cast("double").alias("y"))
    shares = S.share_of_total(points, hidden)
    return shares.withColumn("share", F.round("share", 6))


@query(SHARE.format(where=""))
def share_of_total(spark, folder):
    return _order_shares(spark, folder)


@query(SHARE.format(where="where o_orderpriority <> '5-LOW'"))
def share_hidden(spark, folder):
    """A hidden category leaves the total too."""
    return _order_shares(spark, folder, ["5-LOW"])


@query("select event_type, count(*) as n from events where event_type not in ('click') group by 1")
def visible_series(spark, folder):
    shown = visible(table(spark, folder, "events"), "event_type", ["click"])
    return shown.groupBy("event_type").agg(F.count("*").alias("n"))


# -- extents --------------------------------------------------------------------------


@query(f"with {EVENTS} select series, min(y) as lo, max(y) as hi from events_p group by 1")
def series_extents(spark, folder):
    return S.extents(event_points(spark, folder))


@query(f"""
with {EVENTS}
select series, least(min(y), 3) as lo, 400.0::double as hi from events_p
where x >= 1704672000000000 and x <= 1705276800000000 group by 1""")
def extents_bounded(spark, folder):
    """One week, an upper bound set by the user, a lower one suggested."""
    return S.extents(
        event_points(spark, folder),
        other=(1704672000000000, 1705276800000000),
        user=(None, 400.0),
        suggested=(3.0, 500.0),
    )


@query(f"""
with {EVENTS}
select series, min(y) filter (x % 7 = 0 and series <> 'click') as lo,
  max(y) filter (x % 7 = 0 and series <> 'click') as hi
from events_p group by 1""")
def extents_sparse(spark, folder):
    """A series whose points all lie outside keeps its row, without ends."""
    far = (F.col("series") == "click") | (F.col("x") % 7 != 0)
    points = event_points(spark, folder).withColumn("x", F.when(far, -1).otherwise(F.col("x")))
    return S.extents(points, other=(0, None))


@query("""
with p as (
  select strftime(o_orderdate, '%Y-%m') as x, o_orderstatus as series, o_orderkey as id,
    cast(round((o_totalprice - 150000) * 100) as bigint) as y from orders),
l as (select x, series, arg_max(y, id) as v from p group by 1, 2)
select p.x, p.series, p.id, cast(p.y as double) as y,
  cast(p.y + coalesce(sum(l.v) filter (sign(l.v) = sign(p.y)), 0) as double) as top
from p left join l on l.x = p.x and l.series < p.series
where p.y <> 0 group by p.x, p.series, p.id, p.y""")
def stacked_points(spark, folder):
    """Every order of a month on the last orders of the statuses before it."""
    orders = table(spark, folder, "orders")
    points = orders.select(
        F.lit("all").alias("stack"), F.col("o_orderstatus").alias("series"),
        F.col("o_orderstatus").alias("series_order"),
        F.date_format("o_orderdate", "yyyy-MM").alias("x"), F.col("o_orderkey").alias("id"),
        F.round((F.col("o_totalprice") - 150000) * 100).cast("bigint").cast("double").alias("y"),
    )
    return S.stack_series(points).filter(F.col("y") != 0).select("x", "series", "id", "y", "top")


@query(f"""
with {EVENTS}, e as (
  select series, min(y + 5) as lo, max(y + 5) as hi from events_p group by 1)
select series, case when lo > 0 and hi > 0 then 0 else lo end as lo,
  hi + (hi - case when lo > 0 and hi > 0 then 0 else lo end) / 2 * 0.1 as hi from e""")
def extents_adjusted(spark, folder):
    raised = event_points(spark, folder).withColumn("y", F.col("y") + 5)
    return S.adjust_extents(S.extents(raised), begin_at_zero=True, grace="10%")


@query(f"""
with {ORDERS}, m as (select series, min(x) as x from orders_p group by 1)
select series, cast(x as double) - abs(cast(x as double) * 0.05) as lo,
  cast(x as double) + abs(cast(x as double) * 0.05) as hi from m""")
def extents_flat(spark, folder):
    """Equal ends move apart."""
    first = order_points(spark, folder).groupBy("series").agg(
        F.min("x").alias("x"), F.lit(0).alias("y")
    )
    return S.adjust_extents(S.extents(first, axis="x"))


@query("""
with m as (
  select strftime(o_orderdate, '%Y-%m') as x, o_orderstatus as series,
    cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as y
  from orders group by 1, 2),
t as (select sum(y) over (partition by x order by series rows unbounded preceding) as top from m)
select cast(min(top) as double) as lo, cast(max(top) as double) as hi from t""")
def extents_stacked(spark, folder):
    orders = table(spark, folder, "orders")
    monthly = orders.groupBy(
        F.date_format("o_orderdate", "yyyy-MM").alias("x"), F.col("o_orderstatus").alias("series")
    ).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double").alias("y"))
    points = monthly.select(
        F.lit("all").alias("stack"), "series", F.col("series").alias("series_order"), "x", "y",
        F.lit(0).alias("id"),
    )
    return S.extents(S.stack_series(points), axis="top", keys=())


# -- runs, slices, order ----------------------------------------------------------------


def _segments_sql(gap: str) -> str:
    return f"""
with {USERS},
l as (select *, lag(x) over w as px, lag(y) over w as py from users_p
      window w as (partition by series order by x, id)),
k as (select *, case when y is not null and (py is null or {gap}) then 1 else 0 end as brk from l),
g as (select *, sum(brk) over (partition by series order by x, id rows unbounded preceding) as s
      from k)
select series, x, y, id, cast(s - 1 as bigint) as segment from g where y is not null"""


@query(_segments_sql("x - px > 43200000000"))
def gap_segments(spark, folder):
    """Runs per user; a missing value or 12 hours of silence ends one."""
    return S.gap_segments(user_points(spark, folder), gap=12 * 3600 * 1_000_000)


@query(_segments_sql("false"))
def gap_segments_nulls(spark, folder):
    return S.gap_segments(user_points(spark, folder))


@query(f"with {USERS} select *, cast(0 as bigint) as segment from users_p where y is not null")
def gap_segments_spanned(spark, folder):
    return S.gap_segments(user_points(spark, folder), span_gaps=True)


@query("""
with n as (
  select event_type as series, ts as x, value as y, event_id as id,
    lag(ts) over w as px, lead(ts) over w as nx
  from events window w as (partition by event_type order by ts, event_id))
select series, x, y, id from n
where (x >= timestamp '2024-01-08' and x <= timestamp '2024-01-15')
  or (x < timestamp '2024-01-08' and nx >= timestamp '2024-01-08')
  or (x > timestamp '2024-01-15' and px <= timestamp '2024-01-15')""")
def range_slice(spark, folder):
    """One week and the points next to it, by the bare time column."""
    return S.range_slice(timed(spark, folder, "event_type", F.col("value")), *week())


@query("""
with u as (
  select user_id as series, ts as x, case when value >= 20 then value end as y, event_id as id
  from events),
n as (select *, lag(x) over w as px, lead(x) over w as nx from u where y is not null
      window w as (partition by series order by x, id))
select series, x, y, id from u where x >= timestamp '2024-01-08' and x <= timestamp '2024-01-15'
union all
select series, x, y, id from n
where (x < timestamp '2024-01-08' and nx >= timestamp '2024-01-08')
  or (x > timestamp '2024-01-15' and px <= timestamp '2024-01-15')""")
def range_slice_spanned(spark, folder):
    """Neighbours across missing values."""
    known = F.when(F.col("value") >= 20, F.col("value"))
    return S.range_slice(timed(spark, folder, "user_id", known), *week(), span_gaps=True)


def _visible_sql(kept: str) -> str:
    """Slice with neighbours, decimation of what it holds, segments of what is left."""
    return f"""
with e as (
  select event_type as series, ts as x, epoch_us(ts) as t, case when value >= 20 then value end as y, event_id as id from events),
n as (select *, lag(x) over w as px, lead(x) over w as nx from e window w as (partition by series order by x, id)),
v as (
  select series, t as x, y, id from n
  where (x >= timestamp '2024-01-08' and x <= timestamp '2024-01-15')
    or (x < timestamp '2024-01-08' and nx >= timestamp '2024-01-08')
    or (x > timestamp '2024-01-15' and px <= timestamp '2024-01-15')),
r as (select series, min(x) as x0, max(x) as x1, count(*) as n from v group by 1),
b as (select v.*, r.n, cast(floor((v.x - r.x0) / (r.x1 - r.x0) * {WIDTH}) as int) as b from v join r on v.series = r.series),
k as (select *, row_number() over (partition by series, b order by x, id) as a1,
        row_number() over (partition by series, b order by x desc, id desc) as a2,
        row_number() over (partition by series, b order by y, x, id) as a3,
        row_number() over (partition by series, b order by y desc, x, id) as a4 from b),
d as (select series, x, y, id from k where {kept}),
l as (select *, lag(x) over w as px, lag(y) over w as py from d window w as (partition by series order by x, id)),
c as (select *, case when y is not null and (py is null or x - px > 10800000000) then 1 else 0 end as brk from l),
g as (select *, sum(brk) over (partition by series order by x, id rows unbounded preceding) as s from c)
select series, x, y, id, cast(s - 1 as bigint) as segment from g where y is not null"""


def _visible(spark, folder, threshold):
    known = F.when(F.col("value") >= 20, F.col("value"))
    points = timed(spark, folder, "event_type", known)
    micros = points.withColumn("x", F.unix_micros(F.col("x").cast("timestamp")))
    lo, hi = (F.unix_micros(end.cast("timestamp")) for end in week())
    shown = S.decimate_visible(micros, lo, hi, WIDTH, threshold)
    return S.gap_segments(shown, gap=3 * 3600 * 1_000_000)


@query(_visible_sql(f"n <= {4 * WIDTH} or a1 = 1 or (b < {WIDTH} and (a2 = 1 or (y is not null and (a3 = 1 or a4 = 1))))"))
def slice_decimate_segments(spark, folder):
    """One week of every series as it is drawn: slice, decimation of its points, runs."""
    return _visible(spark, folder, None)


@query(_visible_sql(f"a1 = 1 or (b < {WIDTH} and (a2 = 1 or (y is not null and (a3 = 1 or a4 = 1))))"))
def slice_decimate_always(spark, folder):
    """The same without a threshold."""
    return _visible(spark, folder, 0)


@query(f"""
with {EVENTS}, n as (
  select series, x, lag(x) over (partition by series order by id) as px from events_p)
select series, not bool_or(x is null or coalesce(x < px, false)) as sorted from n group by 1""")
def sortedness(spark, folder):
    return S.is_sorted(event_points(spark, folder))


@query(f"""
with {ORDERS}, n as (
  select series, x, lag(x) over (partition by series order by id) as px from orders_p)
select series, not bool_or(x is null or coalesce(x < px, false)) as sorted from n group by 1""")
def sortedness_orders(spark, folder):
    return S.is_sorted(order_points(spark, folder))


# -- times --------------------------------------------------------------------------------


@query("select distinct epoch_us(o_orderdate) as x from orders")
def distinct_times(spark, folder):
    return S.distinct_times(order_points(spark, folder))


@query("""
select epoch_us(o_orderdate) as x from orders union select epoch_us(l_shipdate) from lineitem""")
def distinct_times_labels(spark, folder):
    """Data times and label times together."""
    labels = table(spark, folder, "lineitem").select(
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("x")
    )
    return S.distinct_times(order_points(spark, folder), labels)


def _bucket_sql(unit: str, shift: str = "interval 0 day") -> str:
    return f"""
select cast(date_trunc('{unit}', ts - {shift}) + {shift} as timestamp) as bucket, count(*) as n
from events group by 1"""


def _bucketed(spark, folder, *args):
    events = table(spark, folder, "events")
    return events.groupBy(S.time_bucket(F.col("ts"), *args).alias("bucket")).agg(
        F.count("*").alias("n")
    )


@query(_bucket_sql("week"))
def time_bucket(spark, folder):
    return _bucketed(spark, folder, "week")


@query(_bucket_sql("week", "interval 6 day"))
def time_bucket_sunday(spark, folder):
    return _bucketed(spark, folder, "week", 7)


@query(_bucket_sql("hour"))
def time_bucket_hour(spark, folder):
    return _bucketed(spark, folder, "hour")


@query("""
with b as (select date_trunc('hour', ts) as bucket, count(*) as n from events group by 1),
s as (select unnest(generate_series((select min(bucket) from b), (select max(bucket) from b),
        interval 1 hour)) as bucket)
select cast(s.bucket as timestamp) as bucket, b.n from s left join b on b.bucket = s.bucket""")
def calendar_fill(spark, folder):
    events = table(spark, folder, "events")
    return S.calendar_fill(events, "ts", "hour", {"n": F.count("*")})


@query("""
with b as (select user_id, date_trunc('day', ts) as bucket, count(*) as n,
             cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents
           from events group by 1, 2),
e as (select user_id, min(bucket) as lo, max(bucket) as hi from b group by 1),
s as (select user_id, unnest(generate_series(lo, hi, interval 1 day)) as bucket from e)
select s.user_id, cast(s.bucket as timestamp) as bucket, b.n, b.cents
from s left join b on b.user_id = s.user_id and b.bucket = s.bucket""")
def calendar_fill_users(spark, folder):
    events = table(spark, folder, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return S.calendar_fill(events, "ts", "day", {"n": F.count("*"), "cents": cents}, ["user_id"])


@query("""
with b as (select date_trunc('minute', o_orderdate) as bucket, count(*) as n from orders group by 1),
s as (select unnest(generate_series((select min(bucket) from b), (select max(bucket) from b),
        interval 1 minute)) as bucket)
select cast(s.bucket as timestamp) as bucket, b.n from s left join b on b.bucket = s.bucket""")
def calendar_fill_minute(spark, folder):
    """Millions of steps, laid out in stretches."""
    return S.calendar_fill(table(spark, folder, "orders"), "o_orderdate", "minute", {"n": F.count("*")})


@query("""
select unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate),
  interval 1 month)) as bucket from orders""")
def calendar_spine(spark, folder):
    return S.calendar_spine(table(spark, folder, "orders"), "o_orderdate", "month")


@query(f"""
with {ORDERS}, d as (select distinct series, x from orders_p)
select series, x, percent_rank() over (partition by series order by x) as position from d""")
def time_rank(spark, folder):
    return S.time_rank(order_points(spark, folder))


@query(f"""
with {ORDERS}, d as (select distinct x from orders_p)
select x, percent_rank() over (order by x) as position from d""")
def time_rank_all(spark, folder):
    return S.time_rank(order_points(spark, folder), ())


@query(f"""
with {ORDERS}, d as (
  select distinct series, x from orders_p where x between 820454400000000 and 820713600000000),
n as (select *, count(*) over (partition by series) as n,
        percent_rank() over (partition by series order by x) as position from d),
f as (select series from orders_p group by 1
      except select series from n where n > 1)
select series, x, position from n where n > 1
union all select series, 820454400000000, 0 from f
union all select series, 820713600000000, 1 from f""")
def time_rank_ends(spark, folder):
    """Three days; a status with fewer than two times there has the ends."""
    return S.time_rank(order_points(spark, folder), ends=(820454400000000, 820713600000000))


@query(f"""
with {ORDERS}, d as (select distinct x from orders_p),
r as (select x, percent_rank() over (order by x) as p from d),
n as (select x, p, lead(x) over (order by x) as nx, lead(p) over (order by x) as np from r),
e as (select min(x) as x0, max(x) as x1 from r),
q as (select distinct epoch_us(l_shipdate) + 3600000000 as x from lineitem)
select q.x, round(case when q.x < e.x0 or q.x > e.x1 then (q.x - e.x0) / (e.x1 - e.x0)
  when n.nx is null then n.p
  else n.p + (q.x - n.x) / (n.nx - n.x) * (n.np - n.p) end, 9) as position
from q cross join e asof left join n on n.x <= q.x""")
def time_positions(spark, folder):
    """Ship times placed on the axis of order times."""
    known = order_points(spark, folder)
    asked = table(spark, folder, "lineitem").select(
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) + 3_600_000_000).alias("x")
    )
    placed = S.time_positions(S.time_rank(known, ()), asked, ())
    return placed.withColumn("position", F.round("position", 9))


@query("""
with d as (select distinct epoch_us(o_orderdate) as x from orders),
g as (select x - lag(x) over (order by x) as step from d)
select min(step) as step from g""")
def smallest_step(spark, folder):
    return S.smallest_step(order_points(spark, folder))


@query(f"""
with {EVENTS}, d as (select distinct series, x from events_p),
g as (select series, x - lag(x) over (partition by series order by x) as step from d)
select series, min(step) as step from g group by 1""")
def smallest_step_series(spark, folder):
    return S.smallest_step(event_points(spark, folder), ["series"])


# -- labels --------------------------------------------------------------------------------


@query("""
with f as (select o_orderpriority as label, min(o_orderkey) as first from orders group by 1)
select label, first, row_number() over (order by first, label) - 1 as index from f""")
def label_index(spark, folder):
    return S.label_index(table(spark, folder, "orders"), "o_orderpriority", "o_orderkey")


@query("""
with k as (select p_brand, min(p_partkey) as f from part where p_brand not like '%3' group by 1),
a as (select p_brand as label, row_number() over (order by f) - 1 as i from k),
n as (select p_brand as label, min(p_partkey) as f from part
      where p_brand not in (select label from a) group by 1),
w as (select label, i as position from a
      union all
      select label, row_number() over (order by f) - 1 + (select count(*) from a) from n)
select p.p_partkey as i, p.p_brand as label, w.position
from part p left join w on w.label = p.p_brand""")
def label_positions(spark, folder):
    """All parts on an axis without the brands that end in 3, which follow."""
    part = table(spark, folder, "part")
    brands = S.label_index(part.filter(~F.col("p_brand").like("%3")), "p_brand", "p_partkey")
    points = part.select(F.col("p_partkey").alias("i"), F.col("p_brand").alias("label"))
    return S.label_positions(points, brands.select("label", F.col("index").alias("i")))


# -- nested data to points ---------------------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
KEY_SQL = ", ".join(LINE_KEY)


@query(f"""
select {KEY_SQL}, cast(i as int) as i, x, y from lineitem, lateral (
  values (0, 'quantity', l_quantity), (1, 'price', l_extendedprice), (2, 'discount', l_discount),
    (3, 'tax', null)) v(i, x, y)""")
def zip_to_points(spark, folder):
    """Labels and values as parallel arrays; one value fewer than labels."""
    lines = table(spark, folder, "lineitem").select(
        *LINE_KEY,
        F.array(*[F.lit(s) for s in ("quantity", "price", "discount", "tax")]).alias("labels"),
        F.array("l_quantity", "l_extendedprice", "l_discount").alias("values"),
    )
    return S.arrays_to_points(lines, LINE_KEY, "labels", "values")


@query(f"""
select {KEY_SQL}, cast(i as int) as i, x, y, r from lineitem, lateral (
  values (0, l_quantity, l_extendedprice, l_tax), (1, l_discount, l_tax, null)) v(i, x, y, r)""")
def pairs_to_points(spark, folder):
    """[x, y, size] and [x, y]."""
    lines = table(spark, folder, "lineitem").select(
        *LINE_KEY,
        F.array(
            F.array("l_quantity", "l_extendedprice", "l_tax"), F.array("l_discount", "l_tax")
        ).alias("pairs"),
    )
    return S.pairs_to_points(lines, LINE_KEY, "pairs")


@query("""
select o_orderkey, cast(0 as int) as i, o_orderdate as x, o_totalprice as y, o_custkey as r
from orders""")
def objects_to_points(spark, folder):
    """Objects with a nested value, addressed by a dotted key."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.array(
            F.struct(
                F.col("o_orderdate").alias("at"),
                F.struct(F.struct(F.col("o_totalprice").alias("total")).alias("price")).alias("sum"),
                F.col("o_custkey").alias("size"),
            )
        ).alias("points"),
    )
    return S.objects_to_points(orders, ["o_orderkey"], "points", "at", "sum.price.total", "size")


@query(f"""
select {KEY_SQL}, x, y from lineitem, lateral (
  values ('quantity', l_quantity), ('price', l_extendedprice), ('tax', l_tax)) v(x, y)""")
def map_to_points(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        *LINE_KEY,
        F.create_map(
            F.lit("quantity"), "l_quantity", F.lit("price"), "l_extendedprice", F.lit("tax"), "l_tax"
        ).alias("values"),
    )
    return S.map_to_points(lines, LINE_KEY, "values")


@query(f"""
with f as (select {KEY_SQL}, l_quantity - 25 as s, 10 - l_quantity as e from lineitem)
select {KEY_SQL}, least(s, e) as lo, greatest(s, e) as hi,
  case when abs(least(s, e)) > abs(greatest(s, e)) then greatest(s, e) else least(s, e) end as base,
  case when abs(least(s, e)) > abs(greatest(s, e)) then least(s, e) else greatest(s, e) end as head
from f""")
def range_values(spark, folder):
    lines = table(spark, folder, "lineitem")
    ends = S.range_values(F.col("l_quantity") - 25, 10 - F.col("l_quantity"))
    return lines.select(*LINE_KEY, *[c.alias(n) for n, c in ends.items()])


@query("select event_id, case when value - 50 > 0 then value - 50 end as y from events")
def positive_only(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", S.positive_only(F.col("value") - 50).alias("y"))
