"""Run history: an append-only table of nested run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.rules import CHECK_RESULT
from plumbline.operators.stores import started

RUN_REPORT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("suite_name", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_label", T.StringType()),
        T.StructField("available_columns", T.ArrayType(T.StringType())),
        T.StructField("run_time", T.TimestampType()),
        T.StructField(
            "warnings",
            T.ArrayType(
                T.StructType(
                    [T.StructField("column", T.StringType()), T.StructField("message", T.StringType())]
                )
            ),
        ),
        T.StructField(
            "summary",
            T.StructType(
                [
                    T.StructField("total", T.LongType()),
                    T.StructField("passed", T.LongType()),
                    T.StructField("failed", T.LongType()),
                    T.StructField("success_rate", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("results", T.ArrayType(CHECK_RESULT)),
    ]
)

# Fixed value: how many runs the history shows.
RUNS_KEPT = 50


# Runs are kept by month (days would be many small files), in UTC whatever the session's time zone, so that months follow
# each other as runs do.
_MONTH = "trunc(date_from_unix_date(CAST(floor(unix_micros(run_time) / 86400000000) AS INT)), 'MM')"


def append_runs(reports: DataFrame, path: str) -> None:
    """Add runs to the history table, each to the part of its month. A late run goes where its time belongs."""
    rows = reports.select(*[f.name for f in RUN_REPORT.fields], F.expr(_MONTH).alias("run_month"))
    rows.write.mode("append").partitionBy("run_month").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The whole history; no runs before the first. The schema is given, so no file is opened to infer it."""
    return _by_month(spark, path).drop("run_month")


def newest_runs(spark: SparkSession, path: str, n: int = RUNS_KEPT) -> DataFrame:
    """The newest runs of a history, newest first, as :func:`latest_runs` picks them.

    Opens only the months that hold them: how many runs a month has is known from the files' footers, and
    the driver sees one number for each month. Runs without a time come last.
    """
    runs = _by_month(spark, path)
    left, since = n, None
    for month, count in runs.groupBy("run_month").count().orderBy(F.col("run_month").desc_nulls_last()).collect():
        since, left = month, left - count
        if left <= 0:
            break
    # All months are needed where they do not hold enough runs, or only with those runs that have none.
    chosen = runs if since is None else runs.filter(F.col("run_month") >= F.lit(since))
    return latest_runs(chosen.drop("run_month"), n)


def _by_month(spark: SparkSession, path: str) -> DataFrame:
    kept = T.StructType([*RUN_REPORT.fields, T.StructField("run_month", T.DateType())])
    return started(spark, lambda: spark.read.schema(kept).parquet(path), kept)


def clear_runs(spark: SparkSession, path: str) -> None:
    """Empty the history."""
    kept = _by_month(spark, path).schema
    spark.createDataFrame([], kept).write.mode("overwrite").partitionBy("run_month").parquet(path)


def latest_runs(runs: DataFrame, n: int = RUNS_KEPT) -> DataFrame:
    """The newest runs, newest first. Each task keeps its own newest ``n``; only
    those are merged."""
    return runs.orderBy(F.col("run_time").desc(), F.col("run_id").desc()).limit(n)


def history_results(runs: DataFrame) -> DataFrame:
    """One row per run and rule result.

    The result's fields are picked after the explode, so that a query on a few of
    them reads only those from the nested column.
    """
    exploded = runs.select(
        "run_id",
        "suite_name",
        "source_type",
        "source_label",
        "run_time",
        F.col("summary.success_rate").alias("success_rate"),
        F.explode("results").alias("result"),
    )
    fields = [f"result.`{f.name}`" for f in CHECK_RESULT.fields]
    return exploded.select(*[c for c in exploded.columns if c != "result"], *fields)
