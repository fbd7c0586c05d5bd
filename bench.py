"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list) choose the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f01_wallet_features", "f01_wallet_features_large", "f06_flow_features", "f15_drainer_features", "f28_wallet_analysis",
    "f35_evidence_scan", "g01_transfer_edges_large", "g04_connected_components", "g06_distance_to_sources",
    "g10_propagate_scam_penalty", "g18_identity_clusters", "r06_dedupe_scores", "r09_bayes_posterior", "r18_final_score",
    "w01_latest_scores", "w03_rolling_stats", "w07_reputation_state", "w12_escalation_state", "p01_scan_priority",
    "q04_counterparties_large", "q08_summary_compact", "q16_check_transfers", "q17_batch_scores", "u01_usage_hourly",
    "t02_stream_dedupe", "t06_stream_usage_hourly",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from catalog import all_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("ledgerwise-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    queries = all_queries()[0]
    queries["u08_trust_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # session warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
