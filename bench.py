"""Times the headline queries: warm session, median of a few runs, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from palimpsest.plans import load_all
from palimpsest.session import local_session

HEADLINE = (
    "bm25_topk",
    "vector_topk",
    "hybrid_retrieve",
    "select_versions",
    "newer_versions",
    "diff_summary",
    "expand_neighbors",
    "expand_exceptions",
    "validate_citations",
    "rates_health",
    "rate_asof",
    "library_overview",
    "run_health",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, "bench", shuffle_partitions=cores)
    queries = load_all().queries
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
    spark.stop()
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)}))


if __name__ == "__main__":
    main()
