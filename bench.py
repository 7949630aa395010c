"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query, median reported (default 3)
BENCH_QUERIES  comma-separated names, or "all" for every registered query
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lattica.plans import QUERIES  # noqa: E402
from lattica.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    if wanted == "all":
        names = list(QUERIES)
    elif wanted:
        names = wanted.split(",")
    else:
        names = [n for n, q in QUERIES.items() if q.headline]
    spark = local_session("lattica-bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        timings = []
        for run in range(runs + 1):  # the first run warms code generation and Python workers
            started = time.perf_counter()
            QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                timings.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(timings), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds, headline queries, warm median",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
