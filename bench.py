"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs $BENCH_REPEATS times (default 2, the first run includes JIT warm-up); the recorded value is the
median wall time of a full collect of its result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from screenlens.plans.registry import all_queries  # noqa: E402
from screenlens.sources.tables import local_session  # noqa: E402

HEADLINE = ["score_records", "rule_trace", "prep_report", "hazard_dummies", "value_probe", "demo_samples",
            "metrics_by_model", "auc_ovo", "bootstrap_ci", "append_records", "list_records", "bm25_topk",
            "hybrid_topk", "dense_topk"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app="screenlens-bench")
    q = all_queries()
    names = [n for n in HEADLINE if n in q]
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        warm = []
        for _ in range(max(1, repeats)):
            t0 = time.perf_counter()
            rows[name] = len(q[name](spark, sf_dir).collect())
            warm.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(warm), 3)
        print(f"{name}: {times[name]}s ({rows[name]} rows)", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
