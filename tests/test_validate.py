"""Suites as a whole: fusion, isolation, names, totals, reports."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import validate as v
from plumbline.operators.rules import CHECK_RESULT, Rule
from plumbline.registry.inputs import orders_suite
from plumbline.sources import SourceSpec

NOT_NULL = "expect_column_values_to_not_be_null"


def test_results_come_in_rule_order(spark):
    df = spark.range(5).selectExpr("id", "CAST(id AS STRING) AS s")
    rules = [
        Rule("expect_column_values_to_be_unique", {"column": "s"}),
        Rule("expect_nothing", {}),
        Rule("expect_column_mean_to_be_between", {"column": "id", "min_value": 0}),
        Rule("expect_column_to_exist", {"column": "id"}),
        Rule(NOT_NULL, {"column": "s"}),
    ]
    result = v.validate(df, rules)
    assert [(f.name, f.dataType) for f in result.schema.fields] == [
        (f.name, f.dataType) for f in CHECK_RESULT.fields
    ]
    assert [r["pos"] for r in result.collect()] == [0, 1, 2, 3, 4]


def test_schema_only_suite_reads_nothing(spark):
    df = spark.range(5).select(F.raise_error(F.lit("read")).alias("x"))
    rows = v.validate(df, [Rule("expect_column_to_exist", {"column": c}) for c in ("x", "y")]).collect()
    assert [r["success"] for r in rows] == [True, False]


def test_empty_suite_is_rejected(spark):
    with pytest.raises(ValueError):
        v.validate(spark.range(1), [])
    with pytest.raises(ValueError):
        v.validate_many({}, [Rule(NOT_NULL, {"column": "id"})])


def test_names_are_resolved_and_quoted(spark):
    df = spark.createDataFrame([(1, None, 3, 4)], "ID INT, id INT, `a.b` INT, `we``ird` INT")
    rules = [Rule(NOT_NULL, {"column": c}) for c in ("ID", "id", "Id", "a.b", "A.B", "we`ird", "nope")]
    rows = v.validate(df, rules).collect()
    # Another case: the last of several candidates.
    assert [r["column"] for r in rows] == ["ID", "id", "id", "a.b", "a.b", "we`ird", "nope"]
    assert [r["success"] for r in rows] == [True, False, False, True, True, True, False]
    assert rows[4]["kwargs"] == '{"column": "a.b"}'
    warned = [(w["pos"], w["column"], w["suggestion"]) for w in v.missing_column_warnings(df, rules).collect()]
    assert warned == [(2, "Id", "id"), (4, "A.B", "a.b"), (6, "nope", None)]
    assert v.missing_column_warnings(df, rules[:2]).count() == 0


def test_wide_suites_use_several_passes(spark):
    df = spark.range(50).selectExpr(*[f"id + {i} AS c{i}" for i in range(30)])
    rules = [
        Rule("expect_column_values_to_be_between", {"column": f"c{i}", "min_value": i + k})
        for i in range(30)
        for k in range(4)
    ] + [Rule("expect_column_values_to_be_unique", {"column": f"c{i}"}) for i in range(30)]
    rows = v.validate(df, rules).collect()
    assert [r["unexpected_count"] for r in rows] == [k for _ in range(30) for k in range(4)] + [0] * 30
    assert rows == v.validate(df, rules, columns_per_scan=7, measures_per_scan=3).collect()


def test_isolation_keeps_the_other_verdicts(spark):
    df = spark.range(100).select("id", F.expr("CAST(concat('x', id) AS INT) AS broken"))
    rules = [Rule(NOT_NULL, {"column": c}) for c in ("id", "broken", "id", "id", "gone")]
    with pytest.raises(Exception):
        v.validate(df, rules).collect()
    rows = v.validate_isolated(df, rules).collect()
    assert [r["success"] for r in rows] == [True, False, True, True, False]
    assert rows[1]["error"] == "CAST_INVALID_INPUT" and rows[4]["error"] == "no such column: gone"
    healthy = df.select("id")
    assert v.validate_isolated(healthy, rules[:1]).collect() == v.validate(healthy, rules[:1]).collect()


@pytest.mark.parametrize("passed, total, rate", [(1, 16, 6.2), (3, 16, 18.8), (1, 3, 33.3), (7, 7, 100.0), (0, 4, 0.0)])
def test_success_rate_rounds_half_to_even(spark, passed, total, rate):
    results = spark.range(total).selectExpr(f"id < {passed} AS success")
    row = v.run_summary(results).collect()[0]
    assert tuple(row) == (total, passed, total - passed, rate)


def test_success_rates_match_python_rounding(spark):
    pairs = spark.range(1, 121).selectExpr("id AS total", "explode(sequence(0L, id)) AS passed")
    from plumbline.functions import rate_half_even

    rows = pairs.select("total", "passed", rate_half_even(F.col("passed"), F.col("total")).alias("r")).collect()
    assert [r for r in rows if r["r"] != round(r["passed"] / r["total"] * 100, 1)] == []


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "success BOOLEAN")
    assert tuple(v.run_summary(empty).collect()[0]) == (0, 0, 0, 0.0)


def test_status_bands(spark):
    rates = spark.createDataFrame([(100.0,), (99.9,), (80.0,), (79.9,), (0.0,)], "success_rate DOUBLE")
    assert [r["band"] for r in v.run_status(rates).collect()] == ["success", "warn", "warn", "danger", "danger"]


def test_report(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "b INT, a STRING")
    rules = [Rule(NOT_NULL, {"column": "B"}), Rule(NOT_NULL, {"column": "a"})]
    report = v.run_report(df, "s", rules, "local", "f.csv", "run-1").collect()[0]
    assert report["available_columns"] == ["a", "b"]
    assert [tuple(w) for w in report["warnings"]] == [("B", "column 'B' not found; did you mean 'b'?")]
    assert tuple(report["summary"]) == (2, 1, 1, 50.0)
    assert [r["status"] for r in report["results"]] == ["passed", "failed"]
    assert report["run_time"] is not None


def test_validate_source(spark, tmp_path):
    (tmp_path / "people.csv").write_text("id,name,pay\n1,Ann,10\n2,,-500\n2,Bob,\n")
    source = SourceSpec("local", "people.csv", {"root": str(tmp_path)})
    rules = [
        Rule(NOT_NULL, {"column": "name"}),
        Rule("expect_column_values_to_be_between", {"column": "pay", "min_value": 0, "max_value": 200000}),
        *[Rule("expect_column_values_to_be_unique", {"column": c}) for c in ("id", "name", "pay")],
    ]
    result = v.validate_source(spark, source, rules)
    # One scan for the values and one for all three uniqueness rules.
    assert result._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert [r["unexpected_count"] for r in result.collect()] == [1, 1, 2, 0, 0]


VALUES = st.one_of(st.none(), st.floats(width=32), st.sampled_from([0.0, -0.0, 1.0, float("nan")]))


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(VALUES, st.one_of(st.none(), st.sampled_from(["", "a", "ab", "b"]))), max_size=12))
def test_together_equals_one_by_one(spark, rows):
    df = spark.createDataFrame(rows, "x DOUBLE, s STRING")
    rules = [
        Rule("expect_column_values_to_be_between", {"column": "x", "min_value": 0, "mostly": 0.5}),
        Rule("expect_column_values_to_be_unique", {"column": "x"}),
        Rule("expect_column_values_to_be_unique", {"column": "s"}),
        Rule("expect_column_values_to_match_regex", {"column": "s", "regex": "a"}),
        Rule("expect_column_values_to_be_in_set", {"column": "s", "value_set": "a,b"}),
        Rule("expect_table_row_count_to_be_between", {"max_value": 6}),
    ]
    together = [tuple(r)[1:] for r in v.validate(df, rules).collect()]
    alone = [tuple(v.validate(df, [rule]).collect()[0])[1:] for rule in rules]
    assert together == alone
    xs = [x for x, _ in rows if x is not None]
    outside = sum(1 for x in xs if not x >= 0)
    assert (together[0][7], together[0][8]) == (len(xs), outside)
    texts = [s for _, s in rows if s is not None]
    assert together[2][8] == sum(1 for s in texts if texts.count(s) > 1)
    assert together[3][8] == sum(1 for s in texts if "a" not in s)


def test_flagship_has_every_rule_type():
    assert len({r.expectation_type for r in orders_suite()}) == 8
