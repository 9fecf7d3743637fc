"""Benchmark the headline queries.

Runs each query in a fresh plan on ``local[$BENCH_CPUS]`` over
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1), fully materialising the
result, and prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "curate_e2e", "dedup_global", "dedup_windowed", "split_stratified", "cross_split_similar",
    "leak_counts", "auroc_ovr", "domain_report", "leaderboard", "aug_rows", "quality_gate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from textcurate.plans import registry
    from textcurate.session import build_session

    # the bench tables are one row group each: the session deals them out over the cores
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.textcurate.inputPartitions": str(int(cpus) * 2), "spark.driver.memory": "16g"})
    registry.load_all()
    # JVM and parquet reader warm-up outside the timed region
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(1).collect()
    times = {}
    for n in names:
        if n not in registry.QUERIES:
            continue
        t0 = time.time()
        df = registry.QUERIES[n](spark, sf_dir)
        # the noop sink materialises every column (count() would let Catalyst prune)
        df.write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"# {n}: {times[n]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
