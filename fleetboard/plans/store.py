"""Results of reports kept across calls.

A result is known by its report, its bounds and the state of the files it was
made from: their paths, sizes and times of change.  While these are the same, a
later call (of this application or another one that shares the folder) reads the
result and no trip.  When a file was added, changed or removed, the next call
makes the result anew and drops the old one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetboard.operators.filters import Day, as_day
from fleetboard.schema import Tables
from fleetboard.session import checkpoint_dir

from .reports import DASHBOARDS, find
from .shared import limited_reports


def files_state(frames: Iterable[DataFrame]) -> str:
    """A digest of the files that frames read: path, size and time of each, as they
    are now.  Their contents are not read."""
    frames = list(frames)
    paths = sorted({path for df in frames for path in df.inputFiles()})
    if not paths:
        raise ValueError("results are only kept for tables read from files")
    files = frames[0].sparkSession.read.format("binaryFile").load(paths)
    mark = F.xxhash64("path", "modificationTime", "length")
    # Order does not matter, so neither do tasks; two sums over different hashes.
    row = files.agg(
        F.count("*").alias("n"), F.bit_xor(mark).alias("a"), F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("b"),
        F.sum("length").alias("bytes"), F.max("modificationTime").cast("string").alias("latest"),
    ).first()
    return hashlib.sha256(json.dumps(list(row)).encode()).hexdigest()[:32]


class ResultStore:
    """Results under ``folder``, by default one in the shared folder of the session."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{checkpoint_dir(spark)}/results"

    def _files(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _there(self, path: str) -> bool:
        files, place = self._files(f"{path}/_SUCCESS")
        return files.exists(place)

    def _request(self, dashboard: str, key: str, start: Day, end: Day) -> str:
        """Where results of a report under these bounds are; a report without dates has none."""
        dates = (as_day(start), as_day(end)) if find(key, dashboard).dated else (None, None)
        name = json.dumps([dashboard, key, *[d and d.isoformat() for d in dates]])
        return f"{self.folder}/{hashlib.sha256(name.encode()).hexdigest()[:32]}"

    def _keep(self, request: str, state: str, rows: DataFrame) -> None:
        files, place = self._files(request)
        if files.exists(place):
            for old in files.listStatus(place):
                files.delete(old.getPath(), True)
        rows.write.mode("overwrite").parquet(f"{request}/{state}")

    def run_dashboard(
        self, dashboard: str, tables: Tables, start: Day = None, end: Day = None, keys: Iterable[str] | None = None
    ) -> dict[str, DataFrame]:
        """The reports ``keys`` of a dashboard, or all, each in its order.  What is not
        stored yet is made from shared summaries and stored."""
        if dashboard not in DASHBOARDS:
            raise ValueError(f"unknown dashboard: {dashboard}")
        keys = list(DASHBOARDS[dashboard] if keys is None else keys)
        state = files_state([tables.trip, tables.boat, tables.driver])
        request = {key: self._request(dashboard, key, start, end) for key in keys}
        missing = [key for key in keys if not self._there(f"{request[key]}/{state}")]
        if missing:
            for key, rows in limited_reports(dashboard, tables, start, end, missing).items():
                self._keep(request[key], state, rows)
        out = {}
        for key in keys:
            report = find(key, dashboard)
            out[key] = report.shown(report.cut(self.spark.read.parquet(f"{request[key]}/{state}")))
        return out

    def run(self, key: str, tables: Tables, start: Day = None, end: Day = None, dashboard: str = "fleet") -> DataFrame:
        """A report by name, as :func:`.reports.run` gives it."""
        find(key, dashboard)
        return self.run_dashboard(dashboard, tables, start, end, [key])[key]

    def clear(self) -> None:
        """Drop every result."""
        files, place = self._files(self.folder)
        files.delete(place, True)
