"""Reading without loss: listings, damaged stores, empty previews; errors that are none of the data's."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import catalog, history, suites
from plumbline.operators.preview import preview
from plumbline.operators.rules import Rule
from plumbline.operators.validate import report_source, run_report, validate_isolated
from plumbline.sources import SourceSpec
from plumbline.sources.files import file_inventory


def test_inventory_lists_folder_datasets_beside_partitions(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    spark.range(3).write.parquet(str(tmp_path / "ds.parquet"))
    spark.range(3).withColumn("dt", F.lit(1)).write.partitionBy("dt").json(str(tmp_path / "plain"))
    spark.range(2).withColumn("dt", F.lit(1)).write.partitionBy("dt").json(str(tmp_path / "k.json"))
    found = file_inventory(spark, str(tmp_path), active=str(tmp_path / "ds.parquet")).collect()
    assert [(r.name, r.active) for r in found] == [("a.csv", False), ("ds.parquet", True), ("k.json", False)]
    assert all(r.size_kb >= 0 for r in found)


@pytest.mark.parametrize("read", [catalog.read_catalog, suites.read_suites])
def test_damaged_stores_raise(spark, tmp_path, read):
    good = json.dumps({"a": {"created_at": "2025-01-01T00:00:00"}})
    for i, text in enumerate((good[:-2], "[]", json.dumps({"a": {"tags": "x", "expectations": 3}}))):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
            read(spark, str(path)).collect()


def test_last_of_equal_keys_counts(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"a": {"owner": "x"}, "a": {"owner": "y"}}')
    assert [(r.name, r.owner) for r in catalog.read_catalog(spark, str(path)).collect()] == [("a", "y")]


def test_preview_of_nothing_keeps_the_total(spark):
    rows = preview(spark.range(0)).collect()
    assert [tuple(r) for r in rows] == [(None, 0)]
    with pytest.raises(ValueError):
        preview(spark.range(1).toDF("Total_Rows"))


def test_added_rules_have_one_order(spark):
    store = spark.createDataFrame([("s", "t", [])], suites.SUITE)
    rows = [("s", 1, "expect_column_to_exist", {"column": f"c{i}"}) for i in range(40)]
    orders = set()
    for n in (1, 3, 8):
        more = spark.createDataFrame(rows, "suite string, seq int, expectation_type string, kwargs map<string,string>")
        added = suites.add_rules(store, more.repartition(n)).first().expectations
        orders.add(tuple(r.kwargs["column"] for r in added))
    assert len(orders) == 1


def test_deleting_a_hot_name(spark):
    store = spark.createDataFrame([(n, "t", []) for n in "abc"], suites.SUITE)
    names = spark.createDataFrame([("a",)] * 500 + [(f"x{i}",) for i in range(1000)], "name string")
    assert {r.name for r in suites.delete_suites(store, names).collect()} == {"b", "c"}


def test_unreadable_files_are_no_verdict(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.range(50).write.parquet(path)
    frame = spark.read.parquet(path)
    for part in (tmp_path / "d.parquet").glob("part-*"):
        part.write_bytes(b"no parquet")
    for crc in (tmp_path / "d.parquet").glob(".*.crc"):
        crc.write_bytes(b"")
    with pytest.raises(Exception, match="FAILED_READ|CANNOT_READ|Parquet|parquet"):
        validate_isolated(frame, [Rule("expect_column_values_to_not_be_null", {"column": "id"})]).collect()


def test_report_survives_a_rule_that_breaks_on_the_data(spark):
    frame = spark.createDataFrame([("1",), ("x",)], "a string").select(F.col("a").cast("int").alias("n"), "a")
    rules = [Rule("expect_column_values_to_not_be_null", {"column": c}) for c in ("n", "a")]
    row = run_report(frame, "s", rules, "local", "f", "id", isolated=True).first()
    assert row.summary.total == 2 and row.results[1].success
    if spark.conf.get("spark.sql.ansi.enabled") == "true":
        assert row.results[0].error == "CAST_INVALID_INPUT" and not row.results[0].success


def test_first_run_has_empty_stores(spark, tmp_path):
    absent = str(tmp_path / "none")
    for read in (suites.read_suites, catalog.read_catalog, history.read_runs):
        assert read(spark, absent).collect() == []
    damaged = tmp_path / "runs"
    damaged.mkdir()
    (damaged / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        history.read_runs(spark, str(damaged)).collect()


def test_report_of_a_source(spark, tmp_path):
    staff = "name,salary\nIda,100\n,300000\nOle,5\n"
    (tmp_path / "staff.csv").write_text(staff)
    rules = [
        Rule("expect_column_values_to_not_be_null", {"column": "name"}),
        Rule("expect_column_values_to_be_between", {"column": "salary", "min_value": 0, "max_value": 200000}),
    ]
    source = SourceSpec("local", None, {"root": str(tmp_path)})
    for isolated in (True, False):
        report = report_source(spark, source, "staff", rules, "r1", isolated=isolated).first()
        assert (report["source_type"], report["source_label"]) == ("local", "staff.csv")
        assert [r["unexpected_count"] for r in report["results"]] == [1, 1]
        assert report["summary"]["failed"] == 2
