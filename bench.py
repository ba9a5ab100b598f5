"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tenura.queries.catalogue import QUERIES

HEADLINE = (
    "prioritise",
    "build_gold",
    "profile",
    "coercion_report",
    "duplicate_report",
    "impossible_values",
    "missingness_report",
    "business_features",
    "request_features",
    "numeric_summary",
    "categorical_summary",
    "univariate_auc",
    "discriminating_power",
    "correlation_pairs",
    "hypothesis_tests",
    "leak_scan",
    "screen_decoys",
    "metrics_at",
    "fairness_by_group",
    "threshold_for_recall",
    "gain_by_threshold",
    "gain_over_year",
    "lift_curve",
    "capacity_sensitivity",
    "psi",
    "ks_two_sample",
    "drift_report",
    "decision_rates",
    "latency_quantiles",
    "concentration_curve",
    "stratified_split",
    "fit_logistic_recalibrated",
    "score_accounts",
    "nightly_scoring",
    "cross_validate",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tenura-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/nation.parquet").count()  # start the executor threads
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
