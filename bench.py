"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.  Every query is fully
executed with the ``noop`` sink (no collect), after one warm-up run of the
flagship query.  ``BENCH_REPEATS=3`` reports the median of three runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scholia.plans.catalog import QUERIES  # noqa: E402
from scholia.session import get_spark  # noqa: E402

HEADLINE = [
    "find_quotations", "potential_matches", "match_statistics", "page_quotations_to_item",
    "sentence_languages", "language_counts", "multilingual_items", "page_text", "job_pages",
    "create_jobs", "end_jobs", "job_status", "items_status", "mimetype_counts", "key_audit", "fk_audit",
    "upsert_items", "import_books",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="scholia-bench", shuffle_partitions=int(cpus) * 2,
                      conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    QUERIES["find_quotations"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "1")))
    times = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(sorted(runs)[len(runs) // 2], 3)   # median
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
