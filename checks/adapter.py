"""The star schema as views over the synthetic tables.

The same SQL runs on Spark and on the checking engine.  The synthetic columns
have no NULLs, so the views put some in on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetboard.schema import Tables

VIEWS = {
    "boattrip": """
select l.l_orderkey as orderid, l.l_linenumber as lineno,
  l.l_partkey as boatid, l.l_suppkey as driverid,
  o.o_orderdate as departure, l.l_shipdate as arrival,
  case when l.l_returnflag = 'R' then l.l_shipdate end as datecancelled,
  case when l.l_returnflag = 'R' then null
       else cast(l.l_extendedprice as decimal(18,2)) end as boatamount,
  cast(l.l_quantity as int) as noofpassengers,
  case when l.l_returnflag = 'N' then null when l.l_linestatus = 'F' then 1 else 0 end as ispaid,
  cast(l.l_partkey % 40 as int) as inspectedby,
  case o.o_orderpriority when '5-LOW' then null when '4-NOT SPECIFIED' then ''
       else o.o_orderpriority end as islandtourtype,
  case when o.o_orderstatus = 'P' then '0' when o.o_orderpriority = '4-NOT SPECIFIED' then ''
       when o.o_orderpriority = '5-LOW' then null else o.o_orderstatus end as status,
  case when l.l_linenumber = 7 then null when l.l_discount >= 0.03 then 1 else 0 end
    as checklifevest,
  case when l.l_linenumber = 6 then null when l.l_discount >= 0.05 then 1 else 0 end
    as checklifevestchildren,
  case when l.l_linenumber = 5 then null when l.l_tax >= 0.02 then 1 else 0 end
    as checkfireextandsand,
  case when l.l_tax >= 0.04 then 1 else 0 end as checktrashbin,
  case when l.l_quantity >= 10 then 1 else 0 end as checkgas,
  case when l.l_quantity >= 25 then 1 else 0 end as checkhelper,
  case when l.l_linenumber <= 2 then 1 else 0 end as checkboatmanuniformid
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey""",
    "boat": """
select p_partkey as boatid, concat('B-', cast(p_partkey as varchar(20))) as boatno,
  case when p_type = 'PROMO' then null
       else concat(substr(p_type, 1, 1), lower(substr(p_type, 2))) end as boatsize,
  p_size as boatcapacity,
  case when p_size % 10 = 0 then null when p_size % 2 = 1 then 1 else 0 end as isavailable,
  case when p_size = 1 then null
       else cast(p_retailprice as decimal(18,2)) end as iot_speedKnots
from {part}""",
    "driver": """
select s_suppkey as driverid, substr(s_name, 1, 8) as firstname, substr(s_name, 10) as lastname
from {supplier}""",
}

# Given, so that opening a table reads no file.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
}

SOURCES = ("lineitem", "orders", "part", "supplier")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def star(spark: SparkSession, folder: str) -> Tables:
    """The star schema over the tables in ``folder``."""
    raw = {name: table(spark, folder, name) for name in SOURCES}

    def view(name: str) -> DataFrame:
        used = {n: df for n, df in raw.items() if "{" + n + "}" in VIEWS[name]}
        return spark.sql(VIEWS[name], **used)

    return Tables(trip=view("boattrip"), boat=view("boat"), driver=view("driver"))


def with_views(sql: str) -> str:
    """Checking SQL over the star schema, the views put in front."""
    names = {n: n for n in SOURCES}
    ctes = ", ".join(f"{name} as ({text.format(**names)})" for name, text in VIEWS.items())
    body = sql.strip()
    joiner = ", " + body[5:] if body.lower().startswith("with ") else " " + body
    return f"with {ctes}{joiner}"
