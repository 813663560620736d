"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

from arbora import catalog  # noqa: E402
from arbora.session import local_session  # noqa: E402

HEADLINE = (
    "taxonomy_build flat_metrics hierarchical_metrics ranking_metrics calibration_metrics ood_metrics root_confusion tune_threshold closed_vote leave_one_out bootstrap_native"
    " leakage_check fingerprint_groups word_tokens chrf_pairs tfidf_weights naive_bayes_scores sparse_knn dense_knn segment_sentences noise_combined"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    made = catalog.queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
