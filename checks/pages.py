"""Queries over files, pages and payloads, and their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetboard.functions import full_name
from fleetboard.plans import (
    ResultStore,
    kept,
    metric_by_date,
    payload,
    payload_json,
    payload_text,
    run,
    series_by_position,
    two_metrics,
)
from fleetboard.schema import TRIP
from fleetboard.session import work_path
from fleetboard.sources import column_ends, read_csv_inferred, read_label_value_csv, read_tables

from . import reports
from .adapter import star, table

QUERIES = {}
SQL = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return keep


# -- pages ------------------------------------------------------------------------------


@query("""
select o_orderdate as label, o_totalprice as value from orders
where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01'""")
def metric_page(spark, folder):
    orders = table(spark, folder, "orders")
    return metric_by_date(orders, "o_orderdate", "o_totalprice", "1996-01-01", "1997-12-31")


@query("""
select l_shipdate as label, l_extendedprice as value, l_quantity as second from lineitem
where l_shipdate >= timestamp '1999-01-01'""")
def two_metric_page(spark, folder):
    return two_metrics(
        table(spark, folder, "lineitem"),
        "l_shipdate",
        "l_extendedprice",
        "l_quantity",
        ["l_extendedprice", "l_discount"],
        start="1999-01-01",
    )


# -- files --------------------------------------------------------------------------------


def _orders_csv(spark, folder):
    path = work_path(spark, "orders_csv")
    orders = table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("Date"),
        F.col("o_totalprice").alias("Revenue"),
        F.col("o_custkey").alias("Units"),
    )
    orders.write.option("header", True).csv(path)
    return path


@query("""
select cast(o_orderdate as date) as label, 'Revenue' as series, o_totalprice as value from orders
where o_orderdate between timestamp '1996-01-01' and timestamp '1997-12-31'
union all
select cast(o_orderdate as date), 'Units', cast(o_custkey as double) from orders
where o_orderdate between timestamp '1996-01-01' and timestamp '1997-12-31'""")
def csv_page(spark, folder):
    """CSV with inferred types; columns by position."""
    return series_by_position(
        read_csv_inferred(spark, _orders_csv(spark, folder)), "1996-01-01", "1997-12-31"
    )


@query("""
select cast(o_orderdate as date) as label, 'Revenue' as series, o_totalprice as value from orders
union all
select cast(o_orderdate as date), 'Units', cast(o_custkey as double) from orders""")
def csv_page_one_bound(spark, folder):
    """With one end only the range does not apply."""
    return series_by_position(
        read_csv_inferred(spark, _orders_csv(spark, folder)), start="1996-01-01"
    )


@query("""
select trim(p_name) as label, case when p_size <> 1 then p_retailprice end as value from part""")
def csv_label_value(spark, folder):
    """CSV of label and number with blanks around the cells and cells that are no number."""
    path = work_path(spark, "part_csv")
    number = F.when(F.col("p_size") == 1, F.lit("n/a")).otherwise(
        F.col("p_retailprice").cast("string")
    )
    blank = F.lit("  ")
    table(spark, folder, "part").select(
        F.concat(blank, "p_name", blank).alias("Name"),
        F.concat(blank, number, blank).alias("Price"),
        F.col("p_type").alias("Kind"),
    ).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return read_label_value_csv(spark, path)


@query(f"""
select 'month' as kind, label, value from ({reports.SQL["monthly_revenue"]})
union all select 'size', label, cast(value as double) from ({reports.SQL["boat_size_distribution"]})
union all select 'driver', firstname || ' ' || lastname, cast(driverid as double)
  from ({reports.with_views("select * from driver")})""")
def parquet_tables(spark, folder):
    """The three tables of the star schema written and read back, each in a report."""
    tables = star(spark, folder)
    path = work_path(spark, "star")
    tables.trip.select(*TRIP.names).write.parquet(f"{path}/boattrip")
    tables.boat.write.parquet(f"{path}/boat")
    tables.driver.write.parquet(f"{path}/driver")
    back = read_tables(spark, path)
    months = run("monthly_revenue", back).select(F.lit("month").alias("kind"), "label", "value")
    sizes = run("boat_size_distribution", back, dashboard="overview").select(
        F.lit("size").alias("kind"), "label", F.col("value").cast("double").alias("value")
    )
    drivers = back.driver.select(
        F.lit("driver").alias("kind"), full_name(F.col("firstname"), F.col("lastname")).alias("label"),
        F.col("driverid").cast("double").alias("value"),
    )
    return months.unionByName(sizes).unionByName(drivers)


@query(f"""
with r as ({reports.SQL["trips_per_boat_dated"]})
select 'json' as output, label, value from r union all select 'parquet', label, value from r""")
def kept_outputs(spark, folder):
    """One result kept while two outputs are written from it."""
    path = work_path(spark, "outputs")
    report = run("trips_per_boat", star(spark, folder), dashboard="activity", **reports.H1)
    with kept(report) as rows:
        rows.write.json(f"{path}/json")
        rows.write.parquet(f"{path}/parquet")
    schema = "label string, value bigint"
    read = {"json": spark.read.schema(schema).json, "parquet": spark.read.schema(schema).parquet}
    first, second = (
        load(f"{path}/{name}").select(F.lit(name).alias("output"), "label", "value")
        for name, load in read.items()
    )
    return first.unionByName(second)


@query(reports.SQL["trips_per_boat"])
def json_rows(spark, folder):
    """A report of any length written as JSON lines, one per row."""
    path = work_path(spark, "report_json")
    run("trips_per_boat", star(spark, folder), dashboard="activity").write.json(path)
    return spark.read.schema("label string, value bigint").json(path)


# -- payloads: as JSON lines or as one JSON object, read back as rows -----------------------

HEADER_AND_POINT = (
    "points bigint, series array<struct<label string, type string>>, overall_avg double,"
    " trip_count bigint, label string, values array<double>"
)


def _lines(spark, folder, key, **more):
    """The records of a payload as JSON lines, written and read back."""
    path = work_path(spark, "payload")
    payload_json(payload(key, star(spark, folder), **more)).select("json").write.text(path)
    rows = spark.read.schema(HEADER_AND_POINT).json(path)
    return rows.filter(F.col("series").isNotNull()), rows.filter(F.col("series").isNull())


def _datasets(spark, folder, key, **more):
    """(series, label, value) of the points; names come from the header."""
    head, points = _lines(spark, folder, key, **more)
    names = head.select(F.posexplode("series").alias("i", "s")).select("i", F.col("s.label").alias("series"))
    values = points.select("label", F.posexplode("values").alias("i", "value"))
    return values.join(names, "i").select("series", "label", "value")


@query(f"""
select 'Monthly Revenue' as series, label, value from ({reports.SQL["monthly_revenue"]})""")
def payload_monthly_revenue(spark, folder):
    return _datasets(spark, folder, "monthly_revenue")


@query(f"""
with r as ({reports.SQL["capacity_vs_passengers"]})
select 'Capacity' as series, label, cast(capacity as double) as value from r
union all select 'Avg Passengers', label, avg_passengers from r""")
def payload_capacity(spark, folder):
    """Two series of different chart types."""
    return _datasets(spark, folder, "capacity_vs_passengers")


@query(f"""
select label, value, cast(row_number() over (order by n desc, id) - 1 as bigint) as place from (
  {reports.SQL["trips_per_boat"].replace("select boatno as label, n as value from",
                                         "select boatno as label, n as value, n, boatid as id from")})""")
def payload_trips_per_boat(spark, folder):
    """Places keep the report's order."""
    rows = payload("trips_per_boat", star(spark, folder), dashboard="activity")
    return rows.filter(F.col("place") >= 0).select("label", F.col("values")[0].alias("value"), "place")


@query(f"""
with r as ({reports.SQL["trip_duration"]}), t as (select value, trip_count from r where is_total)
select r.label, r.value, t.value as overall_avg, t.trip_count
from r cross join t where not r.is_total""")
def payload_trip_duration(spark, folder):
    """Two numbers of the header beside the points."""
    head, points = _lines(spark, folder, "trip_duration", dashboard="activity")
    one = head.select("overall_avg", "trip_count", F.lit(1).alias("k"))
    named = points.select("label", F.col("values")[0].alias("value"), F.lit(1).alias("k"))
    return named.join(F.broadcast(one), "k").drop("k")  # a header is one row


@query("select boatsize as label, count(*) as value from ({}) group by 1".format(
    reports.with_views("select * from boat")))
def payload_boat_sizes(spark, folder):
    """Labels may be NULL."""
    _, points = _lines(spark, folder, "boat_size_distribution", dashboard="overview")
    return points.select("label", F.col("values")[0].cast("bigint").alias("value"))


@query(f"""
with r as ({reports.SQL["capacity_vs_passengers"]}),
p as (select *, row_number() over (order by capacity desc, cast(substr(label, 3) as bigint)) - 1 as place from r)
select place, label, cast(capacity as double) as capacity, avg_passengers,
  'Capacity:bar' as first, 'Avg Passengers:line' as second from p""")
def payload_object(spark, folder):
    """The one JSON object of a report, put together from its lines and read strictly:
    every label and value at its place, and the names and types of its series."""
    lines = payload_text("capacity_vs_passengers", star(spark, folder))
    # A check of the whole text, so here it is joined, in order; the report has 15 boats.
    placed = lines.select(F.monotonically_increasing_id().alias("n"), "text")
    text = placed.agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t"))
    text = text.select(F.array_join(F.transform("t", lambda r: r["text"]), "").alias("json"))
    data = "struct<label string, type string, data array<double>>"
    o = text.select(
        F.from_json("json", f"labels array<string>, datasets array<{data}>", {"mode": "FAILFAST"}).alias("o")
    ).select("o.*")
    named = [F.concat_ws(":", F.col("datasets")[i]["label"], F.col("datasets")[i]["type"]) for i in (0, 1)]
    points = F.arrays_zip("labels", F.col("datasets")[0]["data"].alias("a"), F.col("datasets")[1]["data"].alias("b"))
    rows = o.select(named[0].alias("first"), named[1].alias("second"), F.posexplode(points).alias("place", "p"))
    return rows.select(
        F.col("place").cast("bigint").alias("place"), F.col("p")["labels"].alias("label"),
        F.col("p")["a"].alias("capacity"), F.col("p")["b"].alias("avg_passengers"), "first", "second",
    )


@query(reports.SQL["trips_per_boat_dated"])
def stored_report(spark, folder):
    """A report asked for twice: the second time its stored result is read."""
    store = ResultStore(spark)
    for _ in range(2):
        rows = store.run("trips_per_boat", star(spark, folder), dashboard="activity", **reports.H1)
    return rows


ENDS = ("l_quantity", "l_extendedprice", "l_linenumber", "l_orderkey")


def _ends_sql(where: str = "") -> str:
    return " union all ".join(
        f"select '{c}' as \"column\", min({c})::double as lo, max({c})::double as hi, count({c}) as n from lineitem {where}" for c in ENDS
    )


@query(_ends_sql())
def column_ends_footers(spark, folder):
    """Ends and counts of whole columns, from the footers of the files."""
    return column_ends(spark, f"{folder}/lineitem.parquet", ENDS)


@query(_ends_sql("where l_discount > 0.05"))
def column_ends_filtered(spark, folder):
    """The same under a filter, which footers know nothing of."""
    return column_ends(spark, f"{folder}/lineitem.parquet", ENDS, F.col("l_discount") > 0.05)
