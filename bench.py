"""Benchmark the headline queries.

Runs each query marked ``bench=True`` in the registry on
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``:
one warm-up run, then the median of ``$BENCH_REPEATS`` (default 3) timed runs.
Each run executes the whole plan into Spark's ``noop`` sink (no collect).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from agentlake.plans.registry import load_all  # noqa: E402
from agentlake.session import build_session  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = build_session(f"local[{cpus}]", app="agentlake-bench", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": "16g"})
    reg = load_all()
    keys = only or sorted(k for k, q in reg.items() if q.bench)
    times, rows = {}, {}
    from agentlake.sources.tables import read
    # input rows of each headline query's driving table (rows/s = input rows / median seconds)
    driving = {"billing_breakdown": "events", "usage_rollup": "events", "ema_latency": "events",
               "loop_replay": "events", "execution_replay": "events", "redact_text": "documents",
               "exact_cache_replay": "documents", "request_tool_calls": "conversations",
               "semantic_match": "embeddings"}
    counts = {t: read(spark, sf_dir, t).count() for t in set(driving.values())}
    errors = {}
    for k in keys:
        build = reg[k].build
        try:
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
            runs = []
            for _ in range(repeats):
                t0 = time.perf_counter()
                build(spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t0)
            times[k] = round(statistics.median(runs), 3)
        except Exception as e:  # noqa: BLE001 - report the failure, keep benchmarking the rest
            times[k] = None
            errors[k] = str(e)[:300]
    total = round(sum(t for t in times.values() if t is not None), 3)
    for k, t in times.items():
        if k in driving and t:
            rows[k] = int(counts[driving[k]] / t)
    print(json.dumps({"metric": "headline_queries_total_median_sec", "value": total, "unit": "sec",
                      "queries": times, "rows_per_sec": rows, "sf": sf, "cpus": cpus, "repeats": repeats,
                      **({"errors": errors} if errors else {})}))
    spark.stop()


if __name__ == "__main__":
    main()
