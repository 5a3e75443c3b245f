"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    cores of the local session (default 8)
BENCH_RUNS    timed runs per query after one warm-up; the median counts (default 3)
Arguments, if any, name the queries to run.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tablecensus.plans.queries import QUERIES  # noqa: E402
from tablecensus.session import local_session  # noqa: E402


def seconds(query, spark, folder: str) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    took = {}
    for name in sys.argv[1:] or QUERIES:
        seconds(QUERIES[name], spark, folder)
        took[name] = round(
            statistics.median(seconds(QUERIES[name], spark, folder) for _ in range(runs)), 3
        )
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of the median seconds of all queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
