"""Sums and means against math.fsum."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.profile import numeric_stats, profile
from plumbline.operators.rules import Rule
from plumbline.operators.validate import validate
from plumbline.plans.sums import GATHERED, binned, piece_sums, rounded

NAN, INF = float("nan"), float("inf")


def sums(spark, groups, partitions=3):
    rows = [(k, v) for k, values in groups.items() for v in values]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, value double").repartition(partitions)
    parts = binned(df).groupBy("k", "bin").agg(*[F.expr(f"{sql} AS {name}") for name, sql in piece_sums().items()])
    found = rounded(parts.groupBy("k").agg(F.expr(f"{GATHERED} AS bins")), "bins", "total")
    return {r.k: r.total for r in found.collect()}


def doubles(r, n, low, high):
    return [math.ldexp(r.choice((-1, 1)) * (1 + r.random()), r.randint(low, high)) for _ in range(n)]


def test_sums_equal_fsum(spark):
    r = random.Random(2)
    groups = {
        "prices": [round(r.uniform(900, 105_000), 2) for _ in range(3000)],
        "wide": doubles(r, 500, -1000, 1000),
        "small": doubles(r, 200, -1074, -1000),
        "large": [v / 512 for v in doubles(r, 200, 1000, 1023)],
        "cancels": [x for v in doubles(r, 300, -300, 300) for x in (v, -v)] + [1e-300],
        "nothing": [1e16, -1e16, 5.5, -5.5],
        "order": [1e16, 1.0, -1e16, 1.0],
        "zeros": [0.0, -0.0, 0.0],
        "ends": [5e-324, 5e-324, -5e-324, 1.7e308],
        "negative": [-v for v in doubles(r, 100, -3, 3)] + [-1e9],
        "powers": [2.0**i for i in range(-1074, 1023)],
        "tie": [2.0**53, 1.0], "above tie": [2.0**53, 1.0, 2.0**-1074], "below tie": [2.0**53, 1.0, -(2.0**-1074)],
        "odd tie": [2.0**53 + 2, 1.0], "minus tie": [-(2.0**53), -1.0, -(2.0**-600)],
    }
    for i in range(60):
        groups[f"few {i}"] = doubles(r, r.randint(1, 6), -r.choice((2, 60, 900)), r.choice((2, 60, 900)))
    expected = {k: math.fsum(v) for k, v in groups.items()}
    for partitions in (1, 7):
        assert sums(spark, groups, partitions) == expected


def test_values_that_are_no_numbers(spark):
    found = sums(spark, {"nan": [1.0, NAN], "both": [INF, -INF, 2.0], "up": [INF, 1.0, INF], "down": [-INF, 4.0], "none": [None, None], "some": [None, 2.5], "over": [1.7e308] * 2})
    assert math.isnan(found["nan"]) and math.isnan(found["both"]) and found["up"] == INF and found["down"] == -INF
    assert found["none"] is None and found["some"] == 2.5 and found["over"] == INF


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_means_do_not_depend_on_order(spark, partitions):
    r = random.Random(partitions)
    rows = [(v, i % 3 or None, i) for i, v in enumerate([1e16, 1.0, -1e16, 1.0] + [r.uniform(-1e12, 1e12) for _ in range(500)])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "x double, y int, z long").repartition(partitions)
    mean = lambda i: math.fsum(v[i] for v in rows if v[i] is not None) / len([v for v in rows if v[i] is not None])
    expected = [mean(0), mean(1), mean(2)]
    for exact in (True, False):
        assert [p.mean for p in profile(df, exact=exact).collect()] == expected
    assert [p.mean for p in profile(df, columns_per_scan=None).collect()] == expected
    assert [p.mean for p in numeric_stats(df).orderBy("pos").collect()] == expected
    rules = [Rule("expect_column_mean_to_be_between", {"column": c, "min_value": -1e20}) for c in "xyz"]
    assert [p.observed for p in validate(df, rules).collect()] == expected


def test_mean_of_what_cancels(spark):
    df = spark.createDataFrame([(1e16,), (1.0,), (-1e16,), (1.0,)], "x double")
    rule = Rule("expect_column_mean_to_be_between", {"column": "x", "min_value": 0.5, "max_value": 0.5})
    row = validate(df, [rule]).first()
    assert row.success and row.observed == 0.5 and row.element_count == 4
    odd = spark.createDataFrame([(NAN,), (1.0,), (None,)], "x double")
    row = validate(odd, [rule]).first()
    assert not row.success and math.isnan(row.observed) and row.element_count == 2
    row = validate(odd.filter("x is null"), [rule]).first()
    assert not row.success and row.observed is None and row.element_count == 0
