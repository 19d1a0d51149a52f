"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from ridelens.plans import catalog
from ridelens.plans.layers import audit, bronze, silver

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "audit_overview",
    "missing_values",
    "categorical_summary",
    "numeric_summary",
    "data_dictionary",
    "cleaning_summary",
    "duplicate_id_report",
    "first_occurrence_flag",
    "executive_kpis",
    "booking_status_analysis",
    "vehicle_performance",
    "hourly_demand",
    "day_of_week",
    "revenue_summary",
    "monthly_revenue",
    "customer_cancel_reasons",
    "pickup_analysis",
    "route_analysis",
    "payment_analysis",
    "rating_summary",
    "distance_buckets",
    "correlation_matrix",
    "histogram_equal_width",
    "top_routes",
    "filter_bookings",
    "dashboard_kpis",
    "dash_top_routes",
    "daily_revenue",
    "vehicle_insights",
    "key_findings",
    "insights_document",
    "stratified_split",
    "impute_median",
    "metrics_binary",
]


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("ridelens-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # files of one row group per task, so that all cores read
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {
        # the stored tables that reports read, written once
        "build_bronze": timed(lambda: bronze(spark, SF_DIR)),
        "build_audit": timed(lambda: audit(spark, SF_DIR)),
        "build_silver": timed(lambda: silver(spark, SF_DIR)),
    }
    queries = catalog.queries()
    for name in HEADLINE:
        times[name] = timed(lambda: queries[name](spark, SF_DIR))
        print(name, times[name], file=sys.stderr)
    total = round(sum(times.values()), 3)
    scale = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {"metric": "total_time", "value": total, "unit": "sec", "queries": times, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
