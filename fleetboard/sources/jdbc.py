"""Tables behind a JDBC connector.  The driver jar is the user's to supply."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetboard.schema import BOAT, DRIVER, TRIP, Tables


def jdbc_options(url: str, table: str, fetch_size: int = 10_000, **more: str) -> dict[str, str]:
    """Options of one table scan.  Filters, column choice, aggregates and limits
    go to the database where its dialect allows."""
    return {
        "url": url,
        "dbtable": table,
        "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true",
        "pushDownPredicate": "true",
        "pushDownAggregate": "true",
        "pushDownLimit": "true",
        **more,
    }


def day_predicates(column: str, first: dt.date, last: dt.date, days: int = 1) -> list[str]:
    """One predicate per span of days.  With the two open ends and the NULL rows
    they cover the table exactly once, so each becomes one scan task."""
    if last < first or days < 1:
        raise ValueError("need first <= last and days >= 1")
    edges = []
    day = first
    while day <= last:
        edges.append(day)
        day += dt.timedelta(days=days)
    edges.append(last + dt.timedelta(days=1))
    spans = [
        f"{column} >= '{lo.isoformat()}' AND {column} < '{hi.isoformat()}'"
        for lo, hi in zip(edges, edges[1:])
    ]
    return [
        f"{column} < '{edges[0].isoformat()}'",
        *spans,
        f"{column} >= '{edges[-1].isoformat()}'",
        f"{column} IS NULL",
    ]


@dataclass(frozen=True)
class KeySpans:
    """A scan cut into ``tasks`` spans of a numeric key.  The bounds only place
    the cuts: rows beyond them, and NULL keys, are read by the outer tasks."""

    column: str
    low: int
    high: int
    tasks: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.low),
            "upperBound": str(self.high),
            "numPartitions": str(self.tasks),
        }


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    split: KeySpans | list[str] | None = None,
    properties: dict[str, str] | None = None,
    **more: str,
) -> DataFrame:
    """One table, read by one task per span or predicate of ``split``.  Without
    it a single task reads everything, which only suits a small table."""
    options = jdbc_options(url, table, **more)
    if isinstance(split, list):
        given = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(url, table, predicates=split, properties={**given, **(properties or {})})
    if split is not None:
        options |= split.options()
    return spark.read.format("jdbc").options(**options, **(properties or {})).load()


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns and types the reports expect."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    trip: KeySpans | list[str],
    boat: KeySpans | None = None,
    driver: KeySpans | None = None,
    properties: dict[str, str] | None = None,
    **more: str,
) -> Tables:
    """The star schema from a database, each table read in the spans given."""
    read = {
        name: jdbc_table(spark, url, name, split, properties, **more)
        for name, split in (("boattrip", trip), ("boat", boat), ("driver", driver))
    }
    return Tables(
        trip=conform(read["boattrip"], TRIP),
        boat=conform(read["boat"], BOAT),
        driver=conform(read["driver"], DRIVER),
    )
