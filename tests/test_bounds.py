"""Bounds of whole and decimal numbers are exact, and rules come back from a table as they were."""

import math
from decimal import Decimal

import pytest

from plumbline.operators.rules import Rule, read_parameter
from plumbline.operators.suites import load_rules, suite_row
from plumbline.operators.validate import validate

BETWEEN = "expect_column_values_to_be_between"
BIG = 9007199254740993


def unexpected(spark, kind, values, **kwargs):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    row = validate(df, [Rule.parse(BETWEEN, {"column": "x", **kwargs})]).first()
    assert row.error is None and row.success == (row.unexpected_count == 0)
    return row.unexpected_count


def test_large_whole_numbers(spark):
    values = [BIG - 1, BIG, BIG + 1, None, -(2**63), 2**63 - 1]
    for given in (str, int):
        assert unexpected(spark, "long", values, max_value=given(BIG - 1)) == 3
        assert unexpected(spark, "long", values, max_value=given(BIG)) == 2
        assert unexpected(spark, "long", values, min_value=given(BIG)) == 2
        assert unexpected(spark, "long", values, min_value=given(BIG), strict_min=True) == 3
        assert unexpected(spark, "long", values, max_value=given(2**63)) == 0
        assert unexpected(spark, "long", values, min_value=given(2**63 - 1), strict_min=True) == 5
        assert unexpected(spark, "long", values, max_value=given(-(2**63) - 1)) == 5
        assert unexpected(spark, "long", values, max_value=given(10**400)) == 0
        assert unexpected(spark, "long", values, min_value=given(10**400)) == 5


def test_fractions_between_whole_numbers(spark):
    values = [-1, 0, 1, 2, 3, None]
    assert unexpected(spark, "int", values, min_value="0.5", max_value="2.5") == 3
    assert unexpected(spark, "int", values, min_value="0.5", strict_min=True) == 2
    assert unexpected(spark, "int", values, min_value="1", strict_min=True) == 3
    assert unexpected(spark, "smallint", values, min_value="-inf", max_value="inf") == 0
    assert unexpected(spark, "int", values, min_value="inf") == 5
    assert unexpected(spark, "tinyint", values, max_value="3e9", min_value=-0.0) == 1
    assert unexpected(spark, "int", [None], min_value="5") == 0


def test_decimals(spark):
    values = [Decimal("0.10"), Decimal("0.1000000000000000000000000001"), Decimal("-3"), None]
    assert unexpected(spark, "decimal(38,28)", values, max_value="0.1") == 1
    assert unexpected(spark, "decimal(38,28)", values, max_value="0.1000000000000000000000000001") == 0
    assert unexpected(spark, "decimal(38,28)", values, min_value="0.1", strict_min=True) == 2
    assert unexpected(spark, "decimal(38,28)", values, max_value="0.10000000000000000000000000009") == 1
    assert unexpected(spark, "decimal(5,2)", [Decimal("999.99"), Decimal("-0.01")], min_value="-0.015", max_value="1e3") == 0
    assert unexpected(spark, "decimal(5,2)", [Decimal("999.99"), Decimal("-0.01")], min_value="1e3") == 2


def test_doubles_against_bounds_they_cannot_hold(spark):
    values = [float(BIG - 1), float(BIG + 1), 0.1, float("nan"), float("inf")]
    assert unexpected(spark, "double", values, max_value=str(BIG)) == 3
    assert unexpected(spark, "double", values, min_value=str(BIG)) == 3
    assert unexpected(spark, "double", values, max_value="0.1") == 4
    assert unexpected(spark, "double", values, max_value="0.1", strict_max=True) == 5
    assert unexpected(spark, "double", values, min_value="0.1000000000000000055511151231257827", max_value="inf") == 1
    assert unexpected(spark, "double", values, min_value="0.1000000000000000055511151231257828", max_value="inf") == 2
    assert unexpected(spark, "float", [1.5, 2.5], max_value="1.5") == 1


def test_read_bounds():
    assert read_parameter("min_value", "0.05") == 0.05 and isinstance(read_parameter("min_value", 3), float)
    assert read_parameter("max_value", f" {BIG} ") == BIG and isinstance(read_parameter("max_value", BIG), int)
    assert read_parameter("max_value", "0.12345678901234567890123") == Decimal("0.12345678901234567890123")
    assert read_parameter("max_value", " ") is None and read_parameter("max_value", "low") == "low"
    assert math.isinf(read_parameter("max_value", "Infinity")) and math.isnan(read_parameter("max_value", "nan"))
    assert read_parameter("min_value", "1_000") == 1000.0


def test_row_counts_and_large_bounds(spark):
    rule = Rule("expect_table_row_count_to_be_between", {"min_value": 1, "max_value": 10**400})
    assert validate(spark.range(3).toDF("x"), [rule]).first().success


@pytest.mark.parametrize("given", ["[1, 2]", "a, b", ["x", "[1]"], [1, 2.5, None], "", "[", '["q"]'])
def test_value_sets_come_back_as_they_were(spark, given):
    for rule in (Rule.parse("expect_column_values_to_be_in_set", {"column": "x", "value_set": given}), Rule("expect_column_values_to_be_in_set", {"column": "x", "value_set": given})):
        back = load_rules(suite_row(spark, "s", [rule]), "s")[0]
        df = spark.createDataFrame([("1",), ("2",), ("[1",), ("2]",), ("a",), ("q",), ('["q"]',), ("[",), ("",), ("x",)], "x string")
        assert validate(df, [rule]).first().unexpected_count == validate(df, [back]).first().unexpected_count
        assert read_parameter("value_set", rule.kwargs["value_set"]) == back.kwargs["value_set"]


def test_bounds_come_back_as_they_were(spark):
    kwargs = {"column": "x", "min_value": "0.12345678901234567890123", "max_value": str(BIG), "mostly": 0.5, "strict_min": True}
    rule = Rule.parse(BETWEEN, kwargs)
    back = load_rules(suite_row(spark, "s", [rule]), "s")[0]
    assert [back.kwargs[k] for k in ("min_value", "max_value")] == [rule.kwargs[k] for k in ("min_value", "max_value")]
