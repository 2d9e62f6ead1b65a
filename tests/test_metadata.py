"""Suites, run history and catalog as tables."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import WHITE_SPACE, number_or_null, strip
from plumbline.operators import catalog, catalog_index, history, suites, validate
from plumbline.operators.rules import Rule, read_parameter

NOT_NULL = "expect_column_values_to_not_be_null"
BETWEEN = "expect_column_values_to_be_between"
IN_SET = "expect_column_values_to_be_in_set"


@pytest.fixture()
def stored(spark, tmp_path):
    store = {
        "hr": {
            "expectations": [
                {"expectation_type": NOT_NULL, "kwargs": {"column": "name"}},
                {"expectation_type": BETWEEN, "kwargs": {"column": "salary", "min_value": 0.0, "max_value": ""}},
                {"expectation_type": IN_SET, "kwargs": {"column": "dep", "value_set": ["HR", "IT"]}},
            ],
            "created_at": "2024-01-01T00:00:00",
        },
        "empty": {"expectations": [], "created_at": "2024-01-02T00:00:00"},
        "bare": {"created_at": "2024-01-03T00:00:00"},
    }
    path = tmp_path / "suites.json"
    path.write_text(json.dumps(store, indent=2))
    return suites.read_suites(spark, str(path))


def test_suites_are_read_from_json(stored):
    assert {r["suite"]: r["rules"] for r in suites.suite_sizes(stored).collect()} == {"hr": 3, "empty": 0, "bare": 0}
    rules = suites.suite_rules(stored).collect()
    assert [(r["pos"], r["expectation_type"], r["kwargs"]["column"]) for r in rules] == [
        (0, NOT_NULL, "name"), (1, BETWEEN, "salary"), (2, IN_SET, "dep")
    ]


def test_stored_suites_run(spark, stored):
    rules = suites.load_rules(stored, "hr")
    assert rules[1].kwargs == {"column": "salary", "min_value": 0.0, "max_value": None}
    assert rules[2].kwargs == {"column": "dep", "value_set": ["HR", "IT"]}
    df = spark.createDataFrame([("Ann", -500, "HR"), (None, 10, "XX")], "name STRING, salary INT, dep STRING")
    assert [r["unexpected_count"] for r in validate.validate(df, rules).collect()] == [1, 1, 1]
    with pytest.raises(ValueError):
        suites.load_rules(stored, "nope")
    with pytest.raises(ValueError):
        validate.validate(df, suites.load_rules(stored, "empty"))


def test_suite_round_trip(spark):
    rules = [Rule.parse(IN_SET, {"column": "a", "value_set": "x, y"}), Rule.parse(BETWEEN, {"column": "b", "min_value": "1", "max_value": ""})]
    table = suites.suite_row(spark, "s", rules)
    back = suites.load_rules(table, "s")
    assert back[0] == rules[0]
    assert back[1].kwargs == {"column": "b", "min_value": 1.0}


def test_editing(spark, stored):
    requests = spark.createDataFrame(
        [(" new ", "2"), ("new", "1"), ("hr", "9"), ("  ", "9")], "name STRING, created_at STRING"
    )
    created = suites.create_suites(stored, requests)
    assert sorted(r["name"] for r in created.collect()) == ["bare", "empty", "hr", "new"]
    assert created.filter("name = 'new'").first()["created_at"] == "1"
    additions = spark.createDataFrame(
        [("new", 2, BETWEEN, {"column": "b"}), ("new", 1, NOT_NULL, {"column": "a"}), ("new", 3, "expect_x", {}), ("lost", 1, NOT_NULL, {})],
        "suite STRING, seq INT, expectation_type STRING, kwargs MAP<STRING,STRING>",
    )
    added = suites.add_rules(created, additions)
    sizes = {r["suite"]: r["rules"] for r in suites.suite_sizes(added).collect()}
    assert sizes == {"bare": 0, "empty": 0, "hr": 3, "new": 2}
    assert [r.expectation_type for r in suites.load_rules(added, "new")] == [NOT_NULL, BETWEEN]
    removals = spark.createDataFrame([("hr", 0), ("hr", 2), ("hr", 7), ("new", -1)], "suite STRING, pos INT")
    left = suites.suite_rules(suites.remove_rules(added, removals)).orderBy("suite", "pos").collect()
    assert [(r["suite"], r["pos"], r["expectation_type"]) for r in left] == [
        ("hr", 0, BETWEEN), ("new", 0, NOT_NULL), ("new", 1, BETWEEN)
    ]
    gone = spark.createDataFrame([("hr",)], "name STRING")
    assert suites.delete_suites(added, gone).count() == 3


def test_numbers_are_read_as_parameters_are(spark):
    texts = ["1", " 2.5\t", "-3e2", "1_000", "1__0", "abc", "1d", "1f", "0x1", "", "inf", "-Infinity", "nan", "+.5", "5.", ".", "1e", "١"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = {r["t"]: r["n"] for r in df.select("t", number_or_null(F.col("t")).alias("n")).collect()}
    for text in texts[:-1]:
        wanted = read_parameter("min_value", text)
        wanted = wanted if isinstance(wanted, float) else None
        assert repr(got[text]) == repr(wanted), text


def test_strip_matches_python(spark):
    texts = [f"{c}a {c}b{c}" for c in WHITE_SPACE] + ["", " ", "​x"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.range(3)
    for i in range(4):
        stamp = F.to_timestamp(F.lit(f"2024-01-0{1 + i % 3} 00:00:00"))
        rules = [Rule("expect_table_row_count_to_be_between", {"min_value": i})]
        history.append_runs(validate.run_report(df, "s", rules, "local", "r", f"run{i}", stamp), path)
    runs = history.read_runs(spark, path)
    assert [r["run_id"] for r in history.latest_runs(runs, 3).collect()] == ["run2", "run1", "run3"]
    plan = history.latest_runs(runs)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    rows = history.history_results(runs).orderBy("run_id").collect()
    assert [(r["run_id"], r["pos"], r["observed"], r["success_rate"]) for r in rows] == [(f"run{i}", 0, 3.0, 100.0) for i in range(4)]
    narrow = history.history_results(runs).groupBy("run_id").agg(F.count_if("success"))
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "results:array<struct<success:boolean>>" in plan
    history.clear_runs(spark, path)
    assert history.read_runs(spark, path).count() == 0


@pytest.fixture()
def entries(spark, tmp_path):
    store = {
        "staff": {
            "name": "staff", "alias": "Équipe", "description": "100% real", "owner": "Data", "tags": ["HR", "core"],
            "source_type": "local", "source_ref": "staff.csv", "created_at": "2025-01-31T09:10:11.250000",
            "updated_at": "2025-02-01T12:00:30",
        },
        "sales": {
            "name": "sales", "alias": "", "description": None, "tags": [],
            "fields": [{"name": "id", "type": "int", "nullable": False}, {"name": "amount"}],
            "created_at": "2025-02-03T08:15:00",
        },
    }
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(store, ensure_ascii=False), encoding="utf8")
    return catalog.read_catalog(spark, str(path))


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_catalog_reading(entries):
    rows = {r["name"]: r for r in entries.collect()}
    assert rows["staff"]["fields"] is None and rows["staff"]["created_at"].microsecond == 250000
    assert rows["sales"]["owner"] is None
    fields = catalog.described_fields(entries).collect()
    assert [(f["field"], f["type"], f["nullable"]) for f in fields] == [("id", "int", False), ("amount", "", True)]


SEARCHES = pytest.mark.parametrize(
    "text, tag, found",
    [
        ("", "", ["sales", "staff"]), ("STAFF", "", ["staff"]), ("équ", "", ["staff"]), ("0% r", "", ["staff"]),
        (".", "", []), ("data", "hr", ["staff"]), ("", " Cor ", ["staff"]), ("sales", "core", []), ("a", "", ["sales", "staff"]),
    ],
)


@SEARCHES
def test_catalog_search(entries, text, tag, found):
    assert names(catalog.search(entries, text, tag)) == found


@SEARCHES
def test_catalog_search_by_postings(entries, text, tag, found):
    assert names(catalog_index.search_postings(entries, catalog_index.postings(entries), text, tag)) == found


def test_postings_find_what_a_scan_finds(spark, entries, tmp_path):
    made = [(f"n{i}", None if i % 7 == 0 else f"Ölfeld {i % 13}%_x", "\U0001f600ab" if i % 5 else "ab", ["t", f"Tag {i}"] if i % 3 else None) for i in range(300)]
    rows = spark.createDataFrame(made, "name STRING, alias STRING, owner STRING, tags ARRAY<STRING>").withColumn("description", F.lit(""))
    path = str(tmp_path / "postings")
    catalog_index.write_postings(rows, path)
    index = spark.read.parquet(path)
    assert index.count() == index.distinct().count()
    for text, tag in [("ölfeld 1", ""), ("D 12%_", "AG 1"), ("\U0001f600a", ""), ("ab", "tag 29"), ("n29", "t"), ("eld 99", ""), ("", " tAg 1 ")]:
        assert names(catalog_index.search_postings(rows, index, text, tag)) == names(catalog.search(rows, text, tag)), (text, tag)
    narrow = catalog_index.search_postings(rows, index, "ölfeld 12%")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(place), EqualTo(place,text), In(gram" in plan
    none = rows.limit(0)
    assert catalog_index.search_postings(none, catalog_index.postings(none), "abc", "abc").count() == 0


def test_catalog_create(spark, entries):
    schema = (
        "name STRING, alias STRING, description STRING, owner STRING, tags ARRAY<STRING>, source_type STRING,"
        f" source_ref STRING, fields {catalog.FIELDS}, created_at TIMESTAMP_NTZ"
    )
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    later = dt.datetime(2024, 1, 2)
    new = [
        (" bills\n", "\ta ", None, None, [" x", " ", None], None, " keep ", [("f ", None, " d ", None), (" ", "t", "", True)], later),
        ("bills", "first", None, None, None, None, None, None, at),
        ("staff", "taken", None, None, None, None, None, None, at),
        ("  ", "nameless", None, None, None, None, None, None, at),
    ]
    added = catalog.create(entries, spark.createDataFrame(new, schema))
    assert names(added) == ["bills", "sales", "staff"]
    row = added.filter("name = 'bills'").first()
    assert (row["alias"], row["tags"], row["fields"], row["updated_at"]) == ("first", [], [], at)
    clean = catalog.normalize(spark.createDataFrame(new[:1], schema)).first()
    assert (clean["name"], clean["alias"], clean["owner"], clean["tags"]) == ("bills", "a", "", ["x"])
    assert clean["source_ref"] == " keep " and [tuple(f) for f in clean["fields"]] == [("f", "", "d", True)]


def test_catalog_merge_and_delete(spark, entries):
    schema = (
        "name STRING, changed_at STRING, alias STRING, description STRING, owner STRING, tags ARRAY<STRING>,"
        f" source_type STRING, source_ref STRING, fields {catalog.FIELDS}"
    )
    changes = spark.createDataFrame(
        [
            ("staff", "2024-02-02", None, " new ", None, [" t ", ""], None, None, None),
            ("staff", "2024-02-01", "early", "old", "Ops", None, None, None, [("c", "int", "", True)]),
            ("ghost", "2024-02-01", "x", None, None, None, None, None, None),
        ],
        schema,
    ).withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))
    merged = {r["name"]: r for r in catalog.merge(entries, changes).collect()}
    assert sorted(merged) == ["sales", "staff"]
    staff = merged["staff"]
    assert (staff["alias"], staff["description"], staff["owner"], staff["tags"]) == ("early", "new", "Ops", ["t"])
    assert staff["fields"][0]["name"] == "c" and staff["updated_at"].isoformat() == "2024-02-02T00:00:00"
    before = entries.filter("name = 'sales'").first()
    assert merged["sales"] == before
    assert names(catalog.delete(entries, spark.createDataFrame([("staff",), ("ghost",)], "name STRING"))) == ["sales"]


def test_catalog_autofill(spark, entries):
    df = spark.createDataFrame([], "id INT, `it's` ARRAY<STRING>")
    filled = {r["name"]: r for r in catalog.autofill(entries, df, "staff.csv").collect()}
    assert [tuple(f) for f in filled["staff"]["fields"]] == [("id", "int", "", True), ("it's", "array<string>", "", True)]
    assert len(filled["sales"]["fields"]) == 2
