"""States of parts, put together, against the whole."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.profile import profile
from plumbline.operators.profile_states import profile_from_states, profile_state, read_profile_states, write_profile_state
from plumbline.operators.rule_states import (
    merge_rule_states, read_rule_states, results_from_states, rule_state, stream_results, stream_validate,
)
from plumbline.operators.rules import Rule
from plumbline.operators.validate import validate

RULES = [
    Rule.parse("expect_table_row_count_to_be_between", {"min_value": 1, "max_value": ""}),
    Rule.parse("expect_column_values_to_not_be_null", {"column": "price"}),
    Rule.parse("expect_column_values_to_be_between", {"column": "price", "min_value": 0, "max_value": 900}),
    Rule.parse("expect_column_values_to_be_in_set", {"column": "Kind", "value_set": "a,b"}),
    Rule.parse("expect_column_values_to_match_regex", {"column": "kind", "regex": "^[a-c]", "mostly": 0.5}),
    Rule.parse("expect_column_mean_to_be_between", {"column": "price", "min_value": 100, "max_value": 600}),
    Rule.parse("expect_column_mean_to_be_between", {"column": "id", "min_value": 0}),
    Rule.parse("expect_column_values_to_be_unique", {"column": "id"}),
    Rule.parse("expect_column_values_to_be_unique", {"column": "tags", "mostly": 0.1}),
    Rule.parse("expect_column_to_exist", {"column": "kind"}),
    Rule.parse("expect_column_values_to_be_unique", {"column": "nothing"}),
]
SCHEMA = "id long, price double, kind string, tags array<string>, entries map<string,int>"


def table(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [
        (i if i % 50 else 7, r.choice([None, r.uniform(0, 1000), 1e16, -1e16]), r.choice(["a", "b", "c", "x", None]), r.choice([["t"], ["t", None], [], None]), {"k": i % 3})
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows(df):
    return [tuple(r) for r in df.orderBy("pos").collect()]


# profiles


@pytest.mark.parametrize("split", [1, 2, 9])
def test_profile_from_states_equals_the_unsplit_estimate(spark, tmp_path, split):
    df = table(spark).withColumn("empty", F.lit(None).cast("int")).cache()
    for i in range(split):
        write_profile_state(df.filter(F.pmod(F.xxhash64("id", "price"), F.lit(split)) == i), str(tmp_path / "s"), f"p{i}")
    write_profile_state(df.filter("kind = 'a'"), str(tmp_path / "s"), "p0")  # to be replaced
    write_profile_state(df.filter(F.pmod(F.xxhash64("id", "price"), F.lit(split)) == 0), str(tmp_path / "s"), "p0")
    found = rows(profile_from_states(read_profile_states(spark, str(tmp_path / "s"))))
    assert found == rows(profile_from_states(profile_state(df))) == rows(profile_from_states(profile_state(df.coalesce(1))))
    exact = {r["column"]: r for r in profile(df).collect()}
    names = ("pos", "column", "type", "nulls", "unique", "total", "min", "max", "mean")
    for row in (dict(zip(names, f)) for f in found):
        assert {k: v for k, v in row.items() if k != "unique"} == {k: exact[row["column"]][k] for k in row if k != "unique"}
        assert abs(row["unique"] - exact[row["column"]]["unique"]) <= 0.03 * exact[row["column"]]["unique"]
    assert rows(profile(df, exact=False)) == found


def test_profile_states_edges(spark, tmp_path):
    assert profile_from_states(read_profile_states(spark, str(tmp_path / "none"))).count() == 0
    empty = rows(profile_from_states(profile_state(spark.createDataFrame([], SCHEMA))))
    assert [r[3:] for r in empty] == [(0, 0, 0, None, None, None)] * 5
    a, b = spark.range(3).toDF("x"), spark.sql("SELECT 'q' AS x, parse_json('1') AS v")
    found = rows(profile_from_states(profile_state(a).unionByName(profile_state(b))))
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in found if r[1] == "x"] in (
        [(0, "x", "bigint", 3, 3), (0, "x", "string", 1, 1)], [(0, "x", "string", 1, 1), (0, "x", "bigint", 3, 3)],
    )
    assert [r[4] for r in found if r[1] == "v"] == [None]


def test_quantiles_of_parts(spark):
    df = spark.range(20_000).select((F.col("id") * 0.5).alias("x"), F.lit("t").alias("t"), F.lit(float("nan")).alias("nan"))
    parts = [profile_state(df.filter(F.col("x") % 3 == i)) for i in range(3)] + [profile_state(df.filter(F.col("x") % 1 != 0))]
    states = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    row, text, _ = profile_from_states(states, (0.1, 0.5, 0.9)).orderBy("pos").collect()
    assert row.total == 20_000 and abs(row["q0.5"] - 5000) < 200 and abs(row["q0.1"] - 1000) < 200 and abs(row["q0.9"] - 9000) < 200
    assert text["q0.5"] is None and text.unique == 1


# rules


@pytest.mark.parametrize("split", [1, 4])
def test_results_from_states_equal_validate(spark, split):
    df = table(spark)
    parts = [rule_state(df.filter(F.pmod(F.xxhash64("id", "price"), F.lit(split)) == i), RULES) for i in range(split)]
    states = parts[0]
    for more in parts[1:]:
        states = states.unionByName(more)
    expected = rows(validate(df, RULES))
    assert rows(results_from_states(states, RULES, df.schema)) == expected
    assert rows(results_from_states(merge_rule_states(states), RULES, df.schema)) == expected
    assert {r[4] for r in expected} == {True, False}


def test_states_of_nothing_and_of_other_rules(spark, tmp_path):
    df = table(spark, 10)
    nothing = read_rule_states(spark, str(tmp_path / "none"))
    assert rows(results_from_states(nothing, RULES, df.schema)) == rows(validate(df.limit(0), RULES))
    only = [RULES[9]]
    assert rows(results_from_states(rule_state(df, only), only, df.schema)) == rows(validate(df, only))
    with pytest.raises(Exception, match="other rules"):
        results_from_states(rule_state(df, RULES[:4]), RULES[:5], df.schema).collect()
    with pytest.raises(ValueError, match="no rules"):
        rule_state(df, [])
    odd = spark.sql("SELECT make_interval(1) AS i")
    with pytest.raises(ValueError, match="no key"):
        rule_state(odd, [Rule("expect_column_values_to_be_unique", {"column": "i"})])


def test_stream_in_batches_and_from_its_checkpoint(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "states", "checkpoint"))
    first, later = table(spark, 300, 2), table(spark, 200, 3)  # ids come again later
    first.repartition(5).write.parquet(source)

    def run():
        stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 2).parquet(source)
        query = stream_validate(stream, RULES, store, checkpoint)
        query.awaitTermination()
        return query

    run()
    assert spark.read.parquet(store).select("batch").distinct().count() == 3
    assert rows(stream_results(spark, store, RULES, first.schema)) == rows(validate(first, RULES))
    run()  # nothing new
    assert rows(stream_results(spark, store, RULES, first.schema)) == rows(validate(first, RULES))
    later.repartition(3).write.mode("append").parquet(source)
    run()
    both = first.unionByName(later)
    assert spark.read.parquet(store).select("batch").distinct().count() == 5
    found = rows(stream_results(spark, store, RULES, first.schema))
    assert found == rows(validate(both, RULES))
    assert found[7][9] > rows(validate(first, RULES))[7][9] and not math.isnan(found[5][7])


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    df, store = table(spark, 60), str(tmp_path / "s")
    for _ in range(2):
        rule_state(df, RULES).write.mode("overwrite").parquet(f"{store}/batch=0")
    assert rows(stream_results(spark, store, RULES, df.schema)) == rows(validate(df, RULES))


def test_stream_validate_reads_files_of_bounded_rows(spark, monkeypatch):
    """The stream's folder holds files of at most ``STREAM_FILE_ROWS`` rows, however large the table; verdicts as on the whole."""
    from plumbline.registry import queries

    sf = "/root/testdata/sf0.001"
    paths = []

    def recorded(session, name):
        paths.append(scratch(session, name))
        return paths[-1]

    scratch = queries.scratch_path
    monkeypatch.setattr(queries, "STREAM_FILE_ROWS", 500)
    monkeypatch.setattr(queries, "scratch_path", recorded)
    streamed = queries.stream_validate(spark, sf).collect()
    files = spark.read.parquet(paths[0]).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 7 and max(f["count"] for f in files) <= 500
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, queries.validate_lineitem(spark, sf).collect()))
