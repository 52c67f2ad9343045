"""Time every registered query and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an
optional comma-separated choice, ``BENCH_ROUNDS`` how often each query runs (the best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugework import build_session  # noqa: E402
from gaugework.plans.catalogue import QUERIES  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1)))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    rounds = int(os.environ.get("BENCH_ROUNDS", "1"))

    spark = build_session("gaugework-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executor threads and the Python workers before the clock runs.
    spark.range(1000).repartition(cpus).mapInPandas(lambda it: it, "id long").count()

    seconds: dict[str, float] = {}
    for name in chosen:
        best = float("inf")
        for _ in range(rounds):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 4)
    print(
        json.dumps(
            {
                "metric": "total seconds over all registered queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
