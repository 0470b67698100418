"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from shelfwise.plans.catalog import QUERIES  # noqa: E402
from shelfwise.session import build_session  # noqa: E402

HEADLINE = (
    "a1_product_profile",
    "a2_mode",
    "a9_describe",
    "a16_word_frequencies",
    "c3_stratified_kfold",
    "e2_robust_scale",
    "f18_clean_text",
    "j1_attach_labels",
    "j10_nearest_centroid",
    "j11_knn_join",
    "m13_bootstrap_metrics",
    "t3_tfidf",
    "t6_topic_terms",
    "t14_select_topic_set",
    "u6_pivot_table",
    "w9_bootstrap",
    "c20_label_spreading",
    "c15_self_train",
)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, "bench")
    spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand").count().collect()  # warm the JVM
    times = {}
    for name in names:  # a warm-up, then the median of the runs
        runs = []
        for _ in range(1 + RUNS):
            t0 = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[name] = round(median(runs[1:]), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": d}))


if __name__ == "__main__":
    main()
