"""File sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetboard.schema import BOAT, DRIVER, TRIP, Tables


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """The star schema from parquet folders ``boattrip``, ``boat``, ``driver``.

    The schemas are given, so nothing is read to find them, and each report
    still reads only its own columns.
    """
    return Tables(
        trip=spark.read.schema(TRIP).parquet(f"{folder}/boattrip"),
        boat=spark.read.schema(BOAT).parquet(f"{folder}/boat"),
        driver=spark.read.schema(DRIVER).parquet(f"{folder}/driver"),
    )


def read_csv_inferred(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    sampling_ratio: float = 1.0,
) -> DataFrame:
    """CSV with a header and inferred types.

    Inference is one more pass over the files; give ``schema`` for large inputs.
    A type inferred from a sample may not fit the rest, so the default looks at
    every row.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", sampling_ratio).csv(path)


def read_label_value_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV of (label, number) under a header line: cells trimmed, quotes taken
    off, further cells and blank lines dropped, and NULL for a cell that is no
    number."""
    raw = (
        spark.read.schema("label string, value string")
        .option("header", True)
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    filled = raw.filter(F.col("label").isNotNull() | F.col("value").isNotNull())
    return filled.select(F.trim("label").alias("label"), F.col("value").try_cast("double"))


def rows_frame(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """Rows written out in a program."""
    return spark.createDataFrame(rows, schema)
