"""Verdicts of single rules: values kept and violated, NULL, NaN, parameters."""

import math

import pytest

from plumbline.operators.rules import RULE_DESCRIPTIONS, RULE_TYPES, Rule, read_parameter
from plumbline.operators.validate import validate

NAN = float("nan")


def check(df, kind, **kwargs):
    (row,) = validate(df, [Rule(kind, kwargs)]).collect()
    assert row["status"] == ("passed" if row["success"] else "failed")
    return row


def counts(row):
    return row["success"], row["element_count"], row["unexpected_count"]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1.0,), (5.0,), (NAN,), (None,)], "x DOUBLE")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "x DOUBLE, s STRING, i INT")


BETWEEN = "expect_column_values_to_be_between"
NOT_NULL = "expect_column_values_to_not_be_null"
UNIQUE = "expect_column_values_to_be_unique"
REGEX = "expect_column_values_to_match_regex"
IN_SET = "expect_column_values_to_be_in_set"
ROWS = "expect_table_row_count_to_be_between"
MEAN = "expect_column_mean_to_be_between"


def test_nan_is_outside_every_range(numbers):
    assert counts(check(numbers, BETWEEN, column="x", min_value=0)) == (False, 3, 1)
    assert counts(check(numbers, BETWEEN, column="x", max_value=10)) == (False, 3, 1)
    assert counts(check(numbers, BETWEEN, column="x", min_value=float("-inf"))) == (False, 3, 1)


def test_bounds_are_closed_unless_strict(spark):
    df = spark.createDataFrame([(1,), (5,)], "i INT")
    assert check(df, BETWEEN, column="i", min_value=1, max_value=5)["success"]
    assert counts(check(df, BETWEEN, column="i", min_value=1, max_value=5, strict_min=True)) == (False, 2, 1)
    assert counts(check(df, BETWEEN, column="i", min_value=1, max_value=5, strict_max="true")) == (False, 2, 1)
    assert counts(check(df, BETWEEN, column="i", min_value=1, max_value=5, strict_max="")) == (True, 2, 0)


@pytest.mark.parametrize(
    "kwargs, message",
    [
        ({"min_value": "", "max_value": " "}, "absent"),
        ({}, "absent"),
        ({"min_value": 3, "max_value": 2}, "greater"),
        ({"min_value": "low"}, "not a number"),
        ({"min_value": NAN}, "not a number"),
        ({"min_value": 0, "strict_min": "maybe"}, "true or false"),
        ({"min_value": 0, "mostly": 1.5}, "share"),
        ({"min_value": 0, "mostly": "half"}, "share"),
        ({"min_value": 0, "minimum": 3}, "unknown parameter: minimum"),
        ({"min_value": 0, "column": "y"}, "no such column: y"),
        ({"min_value": 0, "column": None}, "missing parameter: column"),
    ],
)
def test_parameter_errors(numbers, kwargs, message):
    row = check(numbers, BETWEEN, **{"column": "x", **kwargs})
    assert not row["success"] and message in row["error"]
    assert row["element_count"] is None


def test_range_needs_numbers(spark):
    df = spark.sql("SELECT DATE'2024-01-01' AS d, 'a' AS s, true AS b, 1.5BD AS m, CAST(3 AS SMALLINT) AS h")
    for column in "dsb":
        assert "not a numeric column" in check(df, BETWEEN, column=column, min_value=0)["error"]
        assert "not a numeric column" in check(df, MEAN, column=column, min_value=0)["error"]
    for column in "mh":
        assert check(df, BETWEEN, column=column, min_value=0, max_value=3)["success"]
        assert check(df, MEAN, column=column, min_value=0, max_value=3)["success"]


def test_mean(numbers, empty, spark):
    row = check(numbers, MEAN, column="x", min_value=0)
    assert not row["success"] and math.isnan(row["observed"])
    row = check(empty, MEAN, column="x", min_value=0)
    assert counts(row) == (False, 0, None) and row["observed"] is None
    df = spark.createDataFrame([(1,), (2,), (None,)], "i BIGINT")
    row = check(df, MEAN, column="i", min_value=1.5, max_value=1.5)
    assert row["success"] and row["observed"] == 1.5 and row["element_count"] == 2
    assert not check(df, MEAN, column="i", min_value=1.5, strict_min=True)["success"]


def test_empty_table(empty):
    assert counts(check(empty, NOT_NULL, column="x")) == (True, 0, 0)
    assert counts(check(empty, NOT_NULL, column="x", mostly=1)) == (True, 0, 0)
    assert counts(check(empty, UNIQUE, column="s")) == (True, 0, 0)
    assert counts(check(empty, REGEX, column="s", regex="a", mostly=0.5)) == (True, 0, 0)
    row = check(empty, ROWS, min_value=0, max_value=0)
    assert row["success"] and row["observed"] == 0


def test_all_null_column(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) AS i FROM range(3)")
    assert counts(check(df, NOT_NULL, column="i")) == (False, 3, 3)
    assert counts(check(df, UNIQUE, column="i")) == (True, 0, 0)
    assert counts(check(df, IN_SET, column="i", value_set="1")) == (True, 0, 0)
    assert check(df, MEAN, column="i", max_value=1)["observed"] is None


def test_mostly_at_the_threshold(spark):
    df = spark.sql("SELECT IF(id < 57, id, NULL) AS i FROM range(100)")
    assert check(df, NOT_NULL, column="i", mostly=0.57)["success"]
    assert not check(df, NOT_NULL, column="i", mostly=0.5701)["success"]
    assert check(df, NOT_NULL, column="i", mostly="")["success"] is False


def test_unique_counts_every_duplicate(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "s STRING")
    assert counts(check(df, UNIQUE, column="s")) == (False, 3, 2)
    assert counts(check(df, UNIQUE, column="s", mostly=0.3)) == (True, 3, 2)


def test_unique_sees_through_long_values(spark):
    # Values over the raw-key length are grouped by digest; the digest's own text
    # is a different value.
    df = spark.sql(
        "SELECT repeat('x', 100) AS s UNION ALL SELECT repeat('x', 100) UNION ALL SELECT repeat('x', 101)"
        " UNION ALL SELECT sha2(repeat('x', 100), 256) UNION ALL SELECT repeat('é', 40)"
        " UNION ALL SELECT repeat('y', 63) UNION ALL SELECT repeat('y', 64)"
    )
    assert counts(check(df, UNIQUE, column="s")) == (False, 7, 2)
    blobs = df.selectExpr("CAST(s AS BINARY) AS s")
    assert counts(check(blobs, UNIQUE, column="s")) == (False, 7, 2)


def test_unique_on_nested_values(spark):
    df = spark.sql(
        """SELECT array(id % 2) AS a, struct(id) AS s, map('k', id) AS m, array(map(1, id % 3)) AS n,
                  parse_json('1') AS v FROM range(4)"""
    )
    assert counts(check(df, UNIQUE, column="a")) == (False, 4, 4)
    assert counts(check(df, UNIQUE, column="s")) == (True, 4, 0)
    assert counts(check(df, UNIQUE, column="m")) == (True, 4, 0)
    assert counts(check(df, UNIQUE, column="n")) == (False, 4, 2)
    assert "uniqueness is not defined" in check(df, UNIQUE, column="v")["error"]


def test_signed_zero_and_nan_are_one_value_each(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (NAN,), (NAN,), (1.0,)], "x DOUBLE")
    assert counts(check(df, UNIQUE, column="x")) == (False, 5, 4)


def test_regex_finds_anywhere(spark):
    df = spark.createDataFrame([("cab", 17), ("xyz", 20), (None, None)], "s STRING, i INT")
    assert counts(check(df, REGEX, column="s", regex="a")) == (False, 2, 1)
    assert counts(check(df, REGEX, column="s", regex="^[a-z]+$")) == (True, 2, 0)
    assert counts(check(df, REGEX, column="s", regex="")) == (True, 2, 0)
    assert counts(check(df, REGEX, column="i", regex="7$")) == (False, 2, 1)
    assert counts(check(df, REGEX, column="s", regex=r"^(?=.*z)\w+'?$")) == (False, 2, 1)
    assert "invalid regular expression" in check(df, REGEX, column="s", regex="(")["error"]
    assert "missing parameter: regex" in check(df, REGEX, column="s")["error"]


def test_texts_need_no_escaping(spark):
    odd = ["it's", "back\\slash", "new\nline", '"', "$1", "é\u3000", ""]
    df = spark.createDataFrame([(v,) for v in odd], "s STRING")
    assert counts(check(df, IN_SET, column="s", value_set=odd)) == (True, 7, 0)
    assert counts(check(df, IN_SET, column="s", value_set=odd[1:])) == (False, 7, 1)
    assert counts(check(df, REGEX, column="s", regex="t's|\\\\|\\n", mostly=0.4)) == (True, 7, 4)


def test_value_sets(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 1.5D, true, DATE'2024-01-01'), (2, 2.0D, false, DATE'2024-01-02'),"
        " (NULL, NULL, NULL, NULL) AS t(i, x, b, d)"
    )
    assert counts(check(df, IN_SET, column="i", value_set=["1", "x"])) == (False, 2, 1)
    assert counts(check(df, IN_SET, column="i", value_set=[1.0, 2.0, 2.5, None])) == (True, 2, 0)
    assert counts(check(df, IN_SET, column="i", value_set="1, 2")) == (True, 2, 0)
    assert counts(check(df, IN_SET, column="x", value_set=[1.5, 2])) == (True, 2, 0)
    assert counts(check(df, IN_SET, column="b", value_set=[True])) == (False, 2, 1)
    assert counts(check(df, IN_SET, column="d", value_set=["2024-01-01", "never"])) == (False, 2, 1)
    assert counts(check(df, IN_SET, column="i", value_set=[])) == (False, 2, 2)
    nested = df.selectExpr("array(i) AS a")
    assert "value set is not defined" in check(nested, IN_SET, column="a", value_set="1")["error"]


def test_row_count_bounds(spark):
    df = spark.range(10)
    assert check(df, ROWS, min_value=10, max_value=10)["success"]
    assert not check(df, ROWS, max_value=9)["success"]
    assert "absent" in check(df, ROWS)["error"]
    assert "unknown parameter: column" in check(df, ROWS, column="id", min_value=1)["error"]


def test_unknown_rule_types(numbers):
    assert "unsupported rule type" in check(numbers, "expect_magic", column="x")["error"]
    with pytest.raises(ValueError):
        Rule.parse("expect_magic", {})
    assert len(RULE_TYPES) == 8 and list(RULE_TYPES) == list(RULE_DESCRIPTIONS)


def test_read_parameter():
    assert read_parameter("min_value", " 1e3 ") == 1000.0
    assert read_parameter("min_value", "abc") == "abc"
    assert read_parameter("max_value", "  ") is None
    assert read_parameter("max_value", None) is None
    assert read_parameter("value_set", " a ,b,, c") == ["a", "b", "", "c"]
    assert read_parameter("value_set", ["a ", 1]) == ["a ", 1]
    assert read_parameter("regex", " x ") == " x "
