"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

import registry

HEADLINE = (
    "profile_counts_lineitem",
    "profile_numeric_lineitem",
    "profile_counts_documents",
    "join_conservation_lineitem_orders",
    "join_conservation_customer_supplier",
    "join_flags_lineitem_orders",
    "unmatched_rows_measured",
    "fan_out_examples",
    "column_overlap_user_customer",
    "join_outer",
    "join_hot_keys",
    "normalize_report",
    "sql_step_agg",
    "outcome_grain_lineitem",
    "outcome_flags_grain",
    "spec_chain_revenue",
    "model_dag_build",
    "lineage_origins",
    "log_summary",
    "csv_typed",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # call sites of every column expression are for debugging only
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    queries = registry.queries()
    # one pass over the tables, so the first query does not pay for JVM start-up
    for table in ("lineitem", "orders", "documents"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
