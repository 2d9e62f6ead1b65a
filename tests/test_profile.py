import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import preview, profile
from plumbline.sources import SourceSpec

NAN = float("nan")


def rows(df):
    return {r["column"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.sql(
        """SELECT CAST(id AS TINYINT) AS t, CAST(id AS SMALLINT) AS h, CAST(id AS DECIMAL(15,2)) AS d,
                  IF(id % 2 = 0, NULL, id) AS n, IF(id = 3, CAST('NaN' AS DOUBLE), id / 2D) AS x,
                  map('k', id) AS m, array(id % 2) AS a, struct(id % 3 AS f) AS s, repeat('z', 100) AS `a.b`,
                  array(map('k', id)) AS am, X'00' AS bin, id > 1 AS b, DATE'2024-01-01' AS day
           FROM range(4)"""
    )


@pytest.mark.parametrize("width", [1, 3, 20, None])
def test_every_type_profiles(mixed, width):
    found = profile.profile(mixed, columns_per_scan=width)
    assert [r["column"] for r in found.collect()] == mixed.columns
    p = rows(found)
    assert {c: p[c]["unique"] for c in p} == {
        "t": 4, "h": 4, "d": 4, "n": 3, "x": 4, "m": 4, "a": 2, "s": 3, "a.b": 1, "am": 4,
        "bin": 1, "b": 2, "day": 1,
    }
    assert {r["total"] for r in p.values()} == {4}
    assert p["n"]["nulls"] == 2 and p["n"]["mean"] == 2.0
    assert (p["d"]["min"], p["d"]["max"], p["d"]["mean"]) == (0.0, 3.0, 1.5)
    # NaN is a number above all others.
    assert p["x"]["min"] == 0.0 and math.isnan(p["x"]["max"]) and math.isnan(p["x"]["mean"])
    assert p["a"]["min"] is None and p["day"]["mean"] is None
    assert p["d"]["type"] == "decimal(15,2)"


def test_pairs_count_like_groups(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
           (0.0D, CAST(-0.0 AS FLOAT), X'', '', TIMESTAMP'2024-01-01', TIMESTAMP_NTZ'2024-01-01', 1.10BD),
           (-0.0D, CAST(0.0 AS FLOAT), X'00', ' ', TIMESTAMP'2024-01-02', TIMESTAMP_NTZ'2024-01-01', 1.1BD),
           (double('NaN'), float('NaN'), CAST(repeat('a', 200) AS BINARY), repeat('a', 200), NULL, NULL, NULL),
           (double('NaN'), float('NaN'), CAST(repeat('a', 199) AS BINARY), repeat('a', 199), NULL, NULL, NULL),
           (NULL, NULL, NULL, NULL, NULL, NULL, NULL) AS t(x, f, b, s, z, n, d)"""
    )
    split, paired = (profile.profile(df, columns_per_scan=w) for w in (1, None))
    assert str(split.collect()) == str(paired.collect())
    assert [r["unique"] for r in paired.collect()] == [3, 3, 5, 5, 3, 2, 2]


def test_wide_tables_and_whole_rows_are_scanned_once(spark, tmp_path):
    wide = spark.range(50).selectExpr(*[f"id % {n + 1} AS v{n}" for n in range(150)])
    wide.write.parquet(str(tmp_path / "wide.parquet"))
    spark.range(9).selectExpr(*[f"id AS v{n}" for n in range(11)]).write.csv(str(tmp_path / "rows.csv"), header=True)
    for name, n in (("wide.parquet", 150), ("rows.csv", 11)):
        found = profile.profile_source(spark, SourceSpec("local", name, {"root": str(tmp_path)}))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1
        assert found.count() == n
    joined = profile.profile_source(spark, SourceSpec("sql", "SELECT * FROM a JOIN b USING (v0)", {"tables": {"a": wide, "b": wide}}))
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert [r["unique"] for r in profile.distinct_counts(wide).collect()] == [min(50, n + 1) for n in range(150)]


def test_columns_can_be_chosen(mixed):
    assert list(rows(profile.profile(mixed, columns=["X", "t"]))) == ["t", "x"]
    with pytest.raises(ValueError):
        profile.profile(mixed, columns=["t", "nope"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "i INT, s STRING, m MAP<STRING,INT>")
    for exact in (True, False):
        p = profile.with_percentages(profile.profile(df, exact=exact)).collect()
        assert [(r["nulls"], r["unique"], r["total"], r["null_pct"], r["unique_pct"]) for r in p] == [
            (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)
        ]
    assert tuple(profile.dataset_summary(df, "").collect()[0]) == (0, 3, 0, "CSV")


def test_percentages_round_half_up(spark):
    df = spark.createDataFrame([(1, 1, 200), (1, 8, 8), (20, 41, 200), (41, 41, 200)], "nulls BIGINT, `unique` BIGINT, total BIGINT")
    found = profile.with_percentages(df).collect()
    assert [(r["null_pct"], r["unique_pct"], r["null_alert"]) for r in found] == [
        (1, 1, False), (13, 100, False), (10, 21, False), (21, 21, True)
    ]


def test_estimates_agree_on_small_data(mixed):
    exact, near = rows(profile.profile(mixed)), rows(profile.profile(mixed, exact=False))
    for column in mixed.columns:
        for key in ("nulls", "unique", "total", "type"):
            assert exact[column][key] == near[column][key], (column, key)


def test_two_columns_of_one_name_but_for_case(spark):
    df = spark.createDataFrame([(1, 5), (1, 6)], "ID INT, id INT")
    assert [(r["column"], r["unique"]) for r in profile.profile(df).collect()] == [("ID", 1), ("id", 2)]


def test_numeric_stats_and_null_counts(mixed, spark):
    assert set(rows(profile.numeric_stats(mixed))) == {"t", "h", "d", "n", "x"}
    assert rows(profile.null_counts(mixed))["n"]["nulls"] == 2
    with pytest.raises(ValueError):
        profile.numeric_stats(mixed.select("b"))
    wide = spark.range(3).selectExpr(*[f"IF(id < {i % 4}, NULL, id) AS c{i}" for i in range(60)])
    assert [r["nulls"] for r in profile.null_counts(wide).collect()] == [i % 4 for i in range(60)]


def test_hot_value_is_merged_before_the_shuffle(spark):
    # A third of the rows share one value: it must reach the shuffle once a task.
    df = spark.range(0, 90_000, 1, 6).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"))
    result = profile.profile(df)
    assert tuple(result.select("nulls", "unique", "total").collect()[0]) == (0, 51, 90_000)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(1)" in plan and "Window" not in plan and "CartesianProduct" not in plan


def test_preview(spark):
    df = spark.range(0, 100, 1, 4)
    top = preview.preview(df, 3, [F.col("id").desc()]).collect()
    assert [tuple(r) for r in top] == [(99, 100), (98, 100), (97, 100)]
    assert preview.preview(df).count() == 10
    with pytest.raises(ValueError):
        preview.preview(df, -1)


def test_columns(mixed):
    listed = preview.columns(mixed).collect()
    assert [(r["name"], r["type"]) for r in listed] == mixed.dtypes


def test_profile_source(spark, tmp_path):
    (tmp_path / "people.csv").write_text("id,name,pay\n1,Ann,10\n2,,-500\n3,Bob,\n")
    source = SourceSpec("local", "people.csv", {"root": str(tmp_path)})
    p = rows(profile.profile_source(spark, source))
    assert (p["name"]["nulls"], p["name"]["unique"]) == (1, 3)
    assert (p["pay"]["min"], p["pay"]["mean"], p["pay"]["type"]) == (-500.0, -245.0, "int")


NESTED = """SELECT * FROM VALUES
    (array('a', 'b'), array(0.0D, 1D), struct('x' AS f, array(1) AS g), map('p', 1, 'q', NULL), array(array(1), array())),
    (array('ab'), array(-0.0D, 1D), struct('x' AS f, array(1) AS g), map('q', NULL, 'p', 1), array(array(), array(1))),
    (array('a,b'), array(1D, 0D), struct(NULL AS f, array(1) AS g), map('p', NULL, 'q', 1), array(array(1, NULL))),
    (array('a', NULL), array(NULL, 1D), struct('N' AS f, array(1) AS g), map('p', 1), array(array(1), NULL)),
    (array('a', 'N'), array(1D), struct('x' AS f, array(1, NULL) AS g), map(), array(array(11))),
    (array('a', ''), array(double('NaN')), struct('x' AS f, CAST(array() AS ARRAY<INT>) AS g), NULL, array(array(1), array(1))),
    (array('a'), array(double('NaN')), struct('x' AS f, NULL AS g), map('p', 1, 'q', NULL), array()),
    (array(), array(), NULL, map('p', 1, 'q', 0), NULL),
    (NULL, NULL, NULL, NULL, NULL),
    (array('1:b'), array(11D), struct('' AS f, array(1) AS g), map('p1', 1), array(array(1), array(1), array()))
    AS t(texts, numbers, pair, entries, arrays)"""


@pytest.mark.parametrize("width", [1, 5, None])
def test_nested_values_are_told_apart(spark, width):
    df = spark.sql(NESTED)
    unique = [r["unique"] for r in profile.profile(df, columns_per_scan=width).collect()]
    # The two zeros, the two NaNs and the two orders of the entries are one value each.
    assert unique == [10, 8, 8, 7, 9]
    plain = [df.select(c).distinct().count() for c in ("texts", "numbers", "pair", "arrays")]
    assert unique[:3] + unique[4:] == plain
    estimated = [r["unique"] for r in profile.profile(df, exact=False).collect()]
    assert all(abs(a - b) <= 1 for a, b in zip(estimated, unique))


def test_nested_keys_have_a_fixed_width(spark):
    from plumbline.plans.grouped import value_counts

    df = spark.createDataFrame([([float(i)] * 64,) for i in range(5)], "v array<float>")
    plan = value_counts(df, [0])._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange hashpartitioning") :].splitlines()[0]
    assert "hashpartitioning(k0" in exchange and "sha2" in plan
