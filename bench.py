"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the data, ``BENCH_CPUS`` the number of local threads. All
queries run twice to warm up the JVM; then each runs ``BENCH_RUNS`` times and the
median counts. Each run computes all columns of all rows and writes them nowhere.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.preview import row_count
from plumbline.operators.profile import distinct_counts, null_counts, numeric_stats, profile
from plumbline.registry import QUERIES

HEADLINE = (
    "profile_lineitem",
    "profile_approx",
    "distinct_counts",
    "validate_lineitem",
    "validate_suite",
    "validate_documents",
    "null_counts",
    "numeric_stats",
    "dataset_summary",
    "preview_topk",
    "row_count",
    "scan_parquet",
    "sql_source",
    "sql_source_profile",
    "history_results",
    "history_latest",
    "run_status",
    "suite_edit",
    "suite_params",
    "catalog_search",
    "catalog_merge",
    "catalog_create",
)


# Timed without the exact counts that the query holds its estimates against.
OPERATORS = {"profile_approx": lambda spark, sf_dir: profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), exact=False)}


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def one_action_per_statistic(df: DataFrame) -> None:
    """The library's own operators one statistic and one column at a time, for comparison."""
    run(row_count(df))
    for operator in (null_counts, distinct_counts, numeric_stats):
        for name, kind in df.dtypes:
            if operator is not numeric_stats or kind in ("bigint", "int", "double") or kind.startswith("decimal"):
                run(operator(df, [name]))


def timed(action, runs: int) -> float:
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed_queries = {name: OPERATORS.get(name, QUERIES[name]) for name in HEADLINE}
    for _ in range(2):
        for query in timed_queries.values():
            run(query(spark, sf_dir))
    queries = {name: timed(lambda: run(query(spark, sf_dir)), runs) for name, query in timed_queries.items()}
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    comparison = {
        "profile_lineitem_one_action_per_statistic": timed(lambda: one_action_per_statistic(lineitem), runs),
        **{
            f"profile_lineitem_{k}_columns_per_scan": timed(lambda: run(profile(lineitem, columns_per_scan=k)), runs)
            for k in (1, 2, 4, 11)
        },
    }
    found = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "comparison": comparison,
                "sf": float(found.group(1)) if found else sf_dir,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
