"""Ends of columns from the footers of parquet files.

A parquet footer has the least and greatest value and the number of NULLs of every
column of a row group.  Without a filter these answer a minimum, a maximum or a count
over a whole table, and not one page of data is read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from math import isfinite

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENDS = "column string, lo double, hi double, n bigint"


@contextmanager
def by_footers(spark: SparkSession) -> Iterator[None]:
    """Inside, parquet tables that are opened answer aggregates without a filter from
    footers.  Run the query inside too; the session's settings come back at the end."""
    older = [s for s in spark.conf.get("spark.sql.sources.useV1SourceList").split(",") if s and s != "parquet"]
    wanted = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": ",".join(older)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _aggregates(columns: Sequence[str], finite: bool) -> list[Column]:
    """Least, greatest and count of each column; with ``finite`` NaN and infinities are no ends."""
    out = []
    for i, c in enumerate(columns):
        value = F.col(c)
        if finite:
            number = value.cast("double")
            value = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), value)
        out += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"), F.count(c).alias(f"n{i}")]
    return out


def _long(row: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{e}{i}").cast("double").alias(e) for e in ("lo", "hi")], F.col(f"n{i}").alias("n"))
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*rows)))


def column_ends(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """(column, lo, hi, n): the least and greatest finite value of numeric columns of a
    parquet table, and how many of their values are not NULL.

    Without ``where`` footers are asked first, now; writers leave NaN out of their
    ends.  If footers cannot tell (a file without statistics, a column of NULLs only,
    infinite ends), or with a filter, the columns are read.
    """
    columns = list(columns)
    if where is None:
        try:
            with by_footers(spark):
                row = spark.read.parquet(path).agg(*_aggregates(columns, False)).first()
            ends = [
                (c, *(None if row[f"{e}{i}"] is None else float(row[f"{e}{i}"]) for e in ("lo", "hi")), row[f"n{i}"] or 0)
                for i, c in enumerate(columns)
            ]
            if all(v is None or isfinite(v) for _, lo, hi, _ in ends for v in (lo, hi)):
                return spark.createDataFrame(ends, ENDS)
        except (PySparkException, Py4JJavaError):
            # No statistics for a column; another error comes again below.
            pass
    table = spark.read.parquet(path)
    rows = table if where is None else table.filter(where)
    return _long(rows.agg(*_aggregates(columns, True)), columns)
