"""Small Spark helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetboard.session import checkpoint, work_path

__all__ = ["bounded_sample", "checkpoint", "free", "held_out", "id_crc", "small_batches", "stored", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """Let Arrow hand over at most ``BATCH_ROWS`` rows at once in this session: a
    batch of whole texts is held several times on both sides of the pipe."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, and the planner
    knows the size, so it broadcasts only what is under the session's bound."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_crc(key: str = "doc_id") -> Column:
    """CRC-32 of the id as text; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def held_out(modulus: int, rest: int, key: str = "doc_id") -> Column:
    return (id_crc(key) % modulus) == rest


def bounded_sample(df: DataFrame, key: str, cap: int) -> DataFrame:
    """About ``cap`` rows at most, chosen by a hash of the key, the same on each run.

    For fitting a classifier only.  The count decides the share; the rows kept
    are cap plus a few standard deviations at worst.
    """
    n = df.count()
    if n <= cap:
        return df
    share = int((1 << 31) * cap / n)
    return df.where(F.shiftrightunsigned(F.xxhash64(key, F.lit(77)), 33) < share)
