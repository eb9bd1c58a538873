"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed through the ``noop`` sink (nothing is collected to the
driver) and timed; one JSON line is printed:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from variantlake.plans import registry  # noqa: E402
from variantlake.session import get_spark  # noqa: E402

HEADLINE = [
    "pass_at_k", "pass_first_k", "status_metrics", "confusion", "extract_answer", "parse_judge",
    "parse_problems", "score_rollouts", "score_relative", "validate_variants", "flatten_bfs",
    "dedup_semantic", "eval_log", "score_stream",
]
# rows of the driver table each query's work grows with (for rows/s)
DRIVER_ROWS = {"flatten_bfs": "orders", "dedup_semantic": "orders", "validate_variants": "part",
               "parse_problems": "part", "confusion": "labels", "extract_answer": "documents"}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    # one shuffle partition per core locally (AQE coalesces further); clusters size it by data volume
    shuffle = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus)))
    spark = get_spark(app="variantlake-bench", cpus=cpus, shuffle_partitions=shuffle)
    registry.load_all()
    # warm-up: JVM code paths and Python workers (not timed)
    registry.QUERIES["parse_judge"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    registry.QUERIES["score_rollouts"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    timings, rates = {}, {}
    for name in names:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        src = DRIVER_ROWS.get(name, "lineitem")
        n = spark.read.parquet(f"{sf_dir}/{src}.parquet").count()
        rates[name] = round(n / max(timings[name], 1e-9), 1)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "rows_per_sec": rates, "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
