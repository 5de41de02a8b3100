"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "A1_delimited_orders", "A2_catalog_columns", "Q5_sum_by_month", "Q6_time_buckets",
    "Q7_top_orders", "Q9_segment_count", "J1_inferred_relations", "J2_integrity",
    "J4_star_join", "C1_profile_lineitem", "C4_top_texts", "C8_hidden_types", "C10_validity",
    "C13_profile_all_tables", "D7_column_scores", "D11_column_usage", "E1_concept_proposals",
    "E6_merged_mappings", "G6_segmentation", "G7_segment_stats", "G10_crosstab",
    "G14_deep_analysis", "V1_investigation", "T3_period_drops", "T7_ruptures_of_raw_events",
    "I3_ranked_findings", "X1_confidence", "X4_checks", "X5_reliability", "M1_alert_values",
    "M2_alert_history", "N1_product_metrics", "P1_pseudonymized", "P2_reidentified",
    "H1_roles_of_contacts", "H2_histogram",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("tallyglass-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from workload import QUERIES

    QUERIES["G7_segment_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
