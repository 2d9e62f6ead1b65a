"""Verdicts of a write, history by month, and inventories of object stores."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import history
from plumbline.operators.rules import Rule
from plumbline.operators.validate import validate, validate_observed
from plumbline.registry.inputs import run_reports
from plumbline.sources.files import OBJECT_PATH
from tests.test_states import RULES, rows, table

SF = "/root/testdata/sf0.001"


def test_observed_equals_validate(spark, tmp_path):
    df = table(spark)
    assert rows(validate_observed(df, RULES, str(tmp_path / "o"))) == rows(validate(df, RULES))
    assert rows(validate_observed(df, RULES[:5], str(tmp_path / "p"), measures_per_scan=2)) == rows(validate(df, RULES[:5]))
    assert spark.read.parquet(str(tmp_path / "o")).count() == df.count()
    empty = df.limit(0)
    assert rows(validate_observed(empty, RULES, str(tmp_path / "e"))) == rows(validate(empty, RULES))


def test_observing_scans_the_source_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).mapInArrow(count, "id long")
    rules = [
        Rule("expect_column_values_to_not_be_null", {"column": "id"}),
        Rule("expect_column_values_to_be_between", {"column": "id", "max_value": 10}),
        Rule("expect_column_values_to_be_unique", {"column": "id"}),
        Rule("expect_column_mean_to_be_between", {"column": "id", "max_value": 1000}),
    ]
    found = rows(validate_observed(df, rules, str(tmp_path / "o")))
    assert seen.value == 1000 and [r[4] for r in found] == [True, False, True, True]


def test_appending_what_cannot_be_told_apart(spark, tmp_path):
    df = spark.range(5).toDF("id")
    with pytest.raises(ValueError, match="appended"):
        validate_observed(df, [Rule("expect_column_values_to_be_unique", {"column": "id"})], str(tmp_path / "o"), mode="append")
    rule = [Rule("expect_table_row_count_to_be_between", {"max_value": 5})]
    for _ in range(2):
        assert validate_observed(df, rule, str(tmp_path / "o"), mode="append").first().success


def test_history_opens_the_newest_months_only(spark, tmp_path):
    path, runs = str(tmp_path / "runs"), run_reports(spark, SF).cache()
    late = F.col("run_time") < F.lit(dt.datetime(1995, 1, 1))
    for part in (runs.filter(~late).coalesce(2), runs.filter(late).coalesce(2)):
        history.append_runs(part, path)
    newest = history.newest_runs(spark, path, 20)
    expected = [tuple(r) for r in history.latest_runs(runs, 20).collect()]
    assert [tuple(r) for r in newest.collect()] == expected
    plan = newest._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "run_month" in filters
    since = re.search(r"run_month#\d+ >= ([0-9-]+)\)", filters).group(1)
    months = [r.run_month.isoformat() for r in spark.read.parquet(path).select("run_month").distinct().collect()]
    assert 0 < sum(m >= since for m in months) < len(months) / 10
    assert sorted(map(str, history.read_runs(spark, path).collect())) == sorted(map(str, runs.collect()))
    assert len(history.newest_runs(spark, path, 10**6).collect()) == runs.count()


def test_history_of_nothing_and_runs_without_a_time(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert history.newest_runs(spark, path).count() == 0
    runs = run_reports(spark, SF).limit(6).cache()
    history.append_runs(runs.withColumn("run_time", F.when(F.col("run_id") < runs.agg(F.max("run_id")).first()[0], F.col("run_time"))).coalesce(1), path)
    assert [r.run_time is None for r in history.newest_runs(spark, path, 6).collect()] == [False] * 5 + [True]
    history.clear_runs(spark, path)
    assert history.newest_runs(spark, path).count() == 0 and history.read_runs(spark, path).count() == 0


def test_paths_of_object_stores(spark):
    df = spark.createDataFrame([("s3a://b/k/a.csv",), ("/data/a.csv",), ("file:/x/a.csv",), ("gs://b-1/a.json",)], "path string")
    found = df.select(F.regexp_extract("path", OBJECT_PATH, 1), F.regexp_extract("path", OBJECT_PATH, 2)).collect()
    assert [tuple(r) for r in found] == [("b", "k/a.csv"), ("", ""), ("", ""), ("b-1", "a.json")]
