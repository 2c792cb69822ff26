"""Times the benchmark queries on local Spark and prints one JSON line.

Every query gets warm-up runs, then the median of several runs; results go to
the ``noop`` sink, so all rows are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
WARMUPS = int(os.environ.get("BENCH_WARMUPS", "2"))
ONLY = [p for p in os.environ.get("BENCH_ONLY", "q,b").split(",") if p]


def measured(query, spark) -> float:
    """Seconds of one run."""
    start = time.perf_counter()
    query.run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from fareloom.plans.catalog import catalog
    from fareloom.session import local_session
    from fareloom.staging import scratch

    spark = local_session(CPUS, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    with scratch(spark):
        measured(catalog()["q02_hourly_demand"], spark)  # a session's first query is slow, whichever it is
        for name, query in catalog().items():
            if not any(name.startswith(prefix) for prefix in ONLY):
                continue
            seconds = [measured(query, spark) for _ in range(WARMUPS + RUNS)]
            timings[name] = round(statistics.median(seconds[WARMUPS:]), 4)
            print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
