"""Headline-query benchmark.

Runs each headline query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]: one warm-up, then the median of 3 timed runs. Each run
executes the whole plan into Spark's ``noop`` sink (no rows to the driver;
the fit steps of fitted operators run as part of building the plan).
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "quality_report", "describe_numeric", "profile_columns", "impute_ffill", "dedup_first", "scale_robust",
    "label_encode", "roc_auc", "confusion_matrix", "drift_ks", "anomaly_consensus", "histogram",
    "rfm", "regularize", "keywords_tfidf", "word_cloud", "components", "pagerank",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("TESSERA_SHUFFLE_PARTITIONS", str(max(int(cores), 1) * 2))
    from tessera.plans.registry import load_all
    from tessera.session import build_session
    queries, _ = load_all()
    spark = build_session(f"local[{cores}]")
    times = {}
    for name in HEADLINE:
        if name not in queries:
            raise KeyError(f"no such query: {name}")
        runs = []
        for i in range(4):
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i:
                runs.append(dt)
        times[name] = round(statistics.median(runs), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cores": int(cores)}))
    spark.stop()


if __name__ == "__main__":
    main()
