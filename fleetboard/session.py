"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# What the plans in this package count on.  All are SQL settings, so they can
# also be given on an existing session.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A join keyed by series or order splits a hot key instead of sending it to one task.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# A join of two tables that are too big to broadcast shuffles both.  If bounds hold for
# one, the rows of the other without a partner may go first: Spark reads the bounded keys
# into a Bloom filter.  By default it does so from a scan of 10 GB on and for keys from
# 10 MB of files; here from the size on that is not broadcast.  The filter has 8 MB at any
# size: 1 in some 3,000 other keys passes at 4 million keys, 1 in 9 at 10 million.
PRUNED_JOINS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "10MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10GB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "67108864",
}


@contextmanager
def pruned_joins(spark: SparkSession) -> Iterator[None]:
    """Inside, a big join drops rows that the other side's bounds rule out before it
    shuffles them.  Run or persist the query inside too; the session's settings come
    back at the end."""
    before = {name: spark.conf.get(name) for name in PRUNED_JOINS}
    for name, value in PRUNED_JOINS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fleetboard")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate results.

    A cluster names it in ``spark.checkpoint.dir``.  Only a single-machine
    session may fall back to a temporary folder: on a cluster the executors
    would not see it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        own = tempfile.mkdtemp(prefix="fleetboard-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    A written table is computed once, where an RDD checkpoint is computed to count
    it and again to save it, and the planner knows its size.
    """
    path = work_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, among those of this application."""
    return f"{_work(spark)}/{uuid.uuid4().hex}/{name}"


def _work(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/work/{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; frames that
    still read it are of no use after that."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_work(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
