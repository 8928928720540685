"""Time the headline queries; prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and
BENCH_QUERIES (names, comma-separated) choose what runs."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from siftmill.plans import catalog  # noqa: E402

HEADLINE = [
    "q_pool_ids", "q_prefilter_hits", "q_scope_rate_by_source", "q_keyword_frequency", "q_exact_dedupe", "q_minhash_signature", "q_near_dup_groups", "q_contamination", "q_category_rollup", "q_stratified_sample",
    "q_split_assign", "q_keyword_score", "q_soft_targets_two", "q_rates_at_threshold", "q_threshold_sweep", "q_ranking_auc_ap", "q_calibration_bins", "q_latency_percentiles", "q_detect_encoded", "q_language_bucket", "q_kappa", "q_draft_merge", "q_knn_embedding",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark.read.parquet(f"{sf}/documents.parquet").count()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
