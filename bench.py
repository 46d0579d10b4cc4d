"""Time the registered queries: after one warm-up the median of three runs, or of
as many as fit into four seconds for a slow one.

Prints one JSON line.  ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the
number of local cores; ``BENCH_ONLY`` takes a comma-separated list of queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks  # noqa: E402
from checks.adapter import star  # noqa: E402
from fleetboard.plans import open_dashboard  # noqa: E402
from fleetboard.session import local_session  # noqa: E402

RUNS = 3
ENOUGH = 4.0
# The same report with other dates or on another page is not timed again.
REPEATS = ("_from", "_until", "_overview", "_fixed", "_one_bound", "_spanned", "_sunday")


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def median(run) -> float:
    run()
    taken: list[float] = []
    while len(taken) < RUNS and sum(taken) < ENOUGH:
        taken.append(timed(run))
    return round(statistics.median(taken), 4)


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS") or os.cpu_count() or 8)
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cores, cores)

    seconds = {}
    for name, query in checks.queries().items():
        if name in only or (not only and not name.endswith(REPEATS)):
            seconds[name] = median(lambda: noop(query(spark, folder)))

    if not only:
        # One dashboard under one filter, its trips read once or by every report.
        def dashboard(persist: bool) -> None:
            tables = star(spark, folder)
            with open_dashboard("fleet", tables, "1996-01-01", "1997-12-31", persist) as frames:
                for df in frames.values():
                    noop(df)

        for persist in (True, False):
            name = f"dashboard_fleet_{'kept' if persist else 'reread'}"
            seconds[name] = median(lambda: dashboard(persist))

    print(
        json.dumps(
            {
                "metric": "total of per-query medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cores": cores,
                "spark": spark.version,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
