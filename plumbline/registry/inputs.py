"""Datasets that the queries derive from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rules import Rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with NULLs in three columns: the test tables have none."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_custkey") % 100, F.lit(7)).alias("custbucket"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price"),
        F.col("o_orderpriority").alias("prio"),
    )


def orders_suite() -> list[Rule]:
    """Rules on :func:`orders_dirty`: every type, kept and violated."""
    return [
        Rule.parse("expect_column_values_to_not_be_null", {"column": "status"}),
        Rule.parse(
            "expect_column_values_to_be_between",
            {"column": "price", "min_value": "1000", "max_value": "400000"},
        ),
        Rule.parse("expect_table_row_count_to_be_between", {"min_value": 1, "max_value": 1e15}),
        Rule.parse("expect_column_values_to_be_unique", {"column": "o_orderkey"}),
        Rule.parse("expect_column_to_exist", {"column": "Price"}),
        Rule.parse("expect_column_values_to_match_regex", {"column": "prio", "regex": "^[1-5]-"}),
        Rule.parse("expect_column_values_to_be_in_set", {"column": "status", "value_set": "O, F"}),
        Rule.parse(
            "expect_column_mean_to_be_between",
            {"column": "price", "min_value": "200000", "max_value": "300000"},
        ),
        Rule.parse("expect_column_values_to_be_unique", {"column": "custbucket"}),
        Rule.parse(
            "expect_column_values_to_match_regex", {"column": "prio", "regex": "^[1-3]-", "mostly": 0.5}
        ),
    ]


def suite_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object per part, holding one suite of zero to two rules."""
    key = F.col("p_partkey").cast("string")
    by_size = F.col("p_size") % 4
    column = (
        F.when(by_size == 0, "o_totalprice").when(by_size == 1, "O_TotalPrice").otherwise("price")
    )
    low = (
        F.when(by_size == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 ")))
        .when(by_size == 1, "")
        .when(by_size == 2, "low")
        .otherwise("1e3")
    )
    members = F.when(by_size == 3, '["SMALL","LARGE"]').otherwise(F.concat(F.lit(" SMALL ,"), F.col("p_type")))
    between = F.struct(
        F.lit("expect_column_values_to_be_between").alias("expectation_type"),
        F.create_map(F.lit("column"), column, F.lit("min_value"), low).alias("kwargs"),
    )
    in_set = F.struct(
        F.lit("expect_column_values_to_be_in_set").alias("expectation_type"),
        F.create_map(F.lit("column"), F.col("p_brand"), F.lit("value_set"), members).alias("kwargs"),
    )
    rules = (
        F.when(F.col("p_partkey") % 3 == 0, F.filter(F.array(between), lambda _: F.lit(False)))
        .when(F.col("p_partkey") % 3 == 1, F.array(between))
        .otherwise(F.array(between, in_set))
    )
    suite = F.struct(rules.alias("expectations"), F.lit("2024-01-01T00:00:00").alias("created_at"))
    return table(spark, sf_dir, "part").select(
        F.to_json(F.create_map(F.concat(F.lit("suite_"), key), suite)).alias("value")
    )


def catalog_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object per part, holding one catalog entry; every third entry
    lacks ``fields``."""
    key = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("part_"), key)
    fields = F.when(
        F.col("p_partkey") % 3 != 0,
        F.array(
            F.struct(F.lit("id").alias("name"), F.lit("bigint").alias("type"), F.lit("key").alias("description")),
            F.struct(F.col("p_brand").alias("name"), F.lit("string").alias("type"), F.col("p_name").alias("description")),
        ),
    )
    entry = F.struct(
        name.alias("name"),
        F.col("p_name").alias("alias"),
        F.concat(F.lit("100% of type "), F.col("p_type")).alias("description"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("owner"),
        F.array(F.lower("p_type"), F.concat(F.lit("Size "), F.col("p_size").cast("string"))).alias("tags"),
        F.lit("local").alias("source_type"),
        F.lit("part.parquet").alias("source_ref"),
        fields.alias("fields"),
        F.lit("2024-01-01T08:00:00.250000").alias("created_at"),
        F.lit("2024-01-02T09:30:00").alias("updated_at"),
    )
    return table(spark, sf_dir, "part").select(F.to_json(F.create_map(name, entry)).alias("value"))


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run report per order, with three rule results."""
    tests = [
        ("expect_column_values_to_be_between", F.col("o_totalprice") < 250000),
        ("expect_column_values_to_be_in_set", F.col("o_orderstatus") == "O"),
        ("expect_column_values_to_match_regex", F.col("o_orderpriority").rlike("^[1-4]")),
    ]
    results = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(kind).alias("expectation_type"),
                F.lit("c").alias("column"),
                F.lit("{}").alias("kwargs"),
                test.alias("success"),
                F.when(test, "passed").otherwise("failed").alias("status"),
                F.lit(None).cast("string").alias("error"),
                F.lit(None).cast("double").alias("observed"),
                F.lit(1).cast("bigint").alias("element_count"),
                (~test).cast("bigint").alias("unexpected_count"),
            )
            for i, (kind, test) in enumerate(tests)
        ]
    )
    passed = sum((t.cast("bigint") for _, t in tests[1:]), tests[0][1].cast("bigint"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("run_id"),
        F.col("o_orderpriority").alias("suite_name"),
        F.lit("local").alias("source_type"),
        F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("source_label"),
        F.array(F.lit("c")).alias("available_columns"),
        F.col("o_orderdate").cast("timestamp").alias("run_time"),
        F.array().cast("array<struct<column:string,message:string>>").alias("warnings"),
        F.struct(
            F.lit(3).cast("bigint").alias("total"),
            passed.alias("passed"),
            (3 - passed).alias("failed"),
            F.bround(passed / 3 * 100, 1).alias("success_rate"),
        ).alias("summary"),
        results.alias("results"),
    )
