"""Suites of rules as tables.

A suite is one row: ``name``, ``created_at`` and ``expectations``, an array of
``(expectation_type, kwargs)`` in rule order. Editing a suite edits its array, so
the positions of the remaining rules follow by themselves and no rule moves
between rows. Parameter values are kept as text; values that are no text keep
their JSON form.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import number_or_null, strip
from plumbline.operators.rules import RULE_TYPES, Rule, read_parameter
from plumbline.operators.stores import keyed_entries, started

EXPECTATIONS = "array<struct<expectation_type:string,kwargs:map<string,string>>>"
SUITE = f"name STRING, created_at STRING, expectations {EXPECTATIONS}"
_SUITE_JSON = f"struct<expectations:{EXPECTATIONS},created_at:string>"


def read_suites(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Suites kept as JSON objects keyed by suite name: one object per file, or,
    for stores that have outgrown a file, one object per line. No store yet: no suites."""
    text = started(spark, lambda: spark.read.text(path, wholetext=not one_per_line), "value STRING")
    return suites_from_json(text, "value")


def suites_from_json(df: DataFrame, column: str) -> DataFrame:
    """Suite rows from JSON objects keyed by suite name."""
    parsed = keyed_entries(df, column, _SUITE_JSON).toDF("name", "suite")
    return parsed.select(
        "name",
        "suite.created_at",
        F.coalesce("suite.expectations", F.array().cast(EXPECTATIONS)).alias("expectations"),
    )


def suite_rules(suites: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per rule: ``(suite, pos, expectation_type, kwargs)``; with
    ``keep_empty`` a suite without rules has one row without a rule."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return suites.select(
        F.col("name").alias("suite"), explode("expectations").alias("pos", "rule")
    ).select("suite", "pos", "rule.expectation_type", "rule.kwargs")


def suite_sizes(suites: DataFrame) -> DataFrame:
    """Rules per suite; an empty suite has 0."""
    return suites.select(F.col("name").alias("suite"), F.size("expectations").alias("rules"))


def suite_params(rules: DataFrame) -> DataFrame:
    """Parameters of rules with their values read: ``number`` for bounds that are
    numbers, ``items`` for value sets, ``text`` as given. A blank bound, or one
    that is no number, has no ``number``."""
    long = rules.select("suite", "pos", F.explode("kwargs").alias("key", "text"))
    is_bound = F.col("key").isin("min_value", "max_value")
    listed = F.from_json("text", "array<string>")
    split = F.transform(F.split("text", ","), strip)
    items = F.when(F.col("text").startswith("["), F.coalesce(listed, split)).otherwise(split)
    return long.select(
        "suite",
        "pos",
        "key",
        "text",
        F.when(is_bound, number_or_null(F.col("text"))).alias("number"),
        F.when(F.col("key") == "value_set", items).alias("items"),
    )


def suite_warnings(rules: DataFrame, dataset: DataFrame) -> DataFrame:
    """Rules that name a column ``dataset`` does not have under that name, with
    the column that differs in case only as a suggestion.

    The column names are part of the plan: no join, and nothing is shuffled.
    """
    names = dataset.columns
    by_fold = {c.lower(): c for c in names}
    folds = F.create_map(*[F.lit(x) for pair in by_fold.items() for x in pair])
    column = F.col("kwargs")["column"]
    suggestion = F.try_element_at(folds, F.lower("column"))
    hint = F.concat(F.lit("; did you mean '"), F.col("suggestion"), F.lit("'?"))
    return (
        rules.select("suite", "pos", column.alias("column"))
        .filter((F.col("column") != "") & ~F.col("column").isin(names))
        .withColumn("suggestion", suggestion)
        .withColumn(
            "message",
            F.concat(
                F.lit("column '"), F.col("column"), F.lit("' not found"), F.coalesce(hint, F.lit(""))
            ),
        )
    )


def create_suites(suites: DataFrame, requests: DataFrame) -> DataFrame:
    """Add empty suites for the requested ``(name, created_at)`` rows.

    Blank names and names already taken are left out; of several requests for one
    name the earliest counts.
    """
    named = requests.select(strip(F.col("name")).alias("name"), "created_at").filter("name <> ''")
    wanted = named.groupBy("name").agg(F.min("created_at").alias("created_at"))
    fresh = wanted.join(suites.select("name").distinct(), "name", "left_anti")
    return suites.unionByName(
        fresh.withColumn("expectations", F.array().cast(EXPECTATIONS))
    )


def add_rules(suites: DataFrame, additions: DataFrame) -> DataFrame:
    """Append rules given as ``(suite, seq, expectation_type, kwargs)``, in the
    order of ``seq``, those with the same ``seq`` by type and parameters. Unknown rule types
    and unknown suites are left out."""
    known = additions.filter(F.col("expectation_type").isin(*RULE_TYPES))
    entries = F.array_sort(F.map_entries("kwargs"))
    rule = F.struct("seq", "expectation_type", entries.alias("entries"))
    per_suite = known.groupBy(F.col("suite").alias("name")).agg(F.collect_list(rule).alias("added"))
    appended = F.transform(
        F.array_sort("added"),
        lambda x: F.struct(x["expectation_type"].alias("expectation_type"), F.map_from_entries(x["entries"]).alias("kwargs")),
    ).cast(EXPECTATIONS)
    return suites.join(per_suite, "name", "left").select(
        "name",
        "created_at",
        F.concat("expectations", F.coalesce(appended, F.array().cast(EXPECTATIONS))).alias("expectations"),
    )


def remove_rules(suites: DataFrame, removals: DataFrame) -> DataFrame:
    """Remove the rules at the given ``(suite, pos)``; positions are those before
    any removal, and positions outside the suite are ignored."""
    sizes = suites.agg(F.max(F.size("expectations")).alias("longest"))
    possible = removals.filter((F.col("pos") >= 0) & (F.col("pos") < sizes.scalar())).select("suite", "pos").distinct()
    per_suite = possible.groupBy(F.col("suite").alias("name")).agg(F.collect_set("pos").alias("gone"))
    kept = F.filter("expectations", lambda rule, pos: ~F.array_contains("gone", pos))
    return suites.join(per_suite, "name", "left").select(
        "name",
        "created_at",
        F.when(F.col("gone").isNull(), F.col("expectations")).otherwise(kept).alias("expectations"),
    )


def delete_suites(suites: DataFrame, names: DataFrame) -> DataFrame:
    """Remove suites by ``name``."""
    return suites.join(names.select("name").distinct(), "name", "left_anti")


def load_rules(suites: DataFrame, name: str) -> list[Rule]:
    """The rules of one suite, ready for validation."""
    found = suites.filter(F.col("name") == name).select("expectations").first()
    if found is None:
        raise ValueError(f"no such suite: {name!r}")
    return [
        Rule(r["expectation_type"], {k: _value(k, v) for k, v in (r["kwargs"] or {}).items()})
        for r in found["expectations"] or []
    ]


def suite_row(spark: SparkSession, name: str, rules: Sequence[Rule], created_at: Column | None = None) -> DataFrame:
    """A suite built in the program, as a table row."""
    rows = [
        (
            r.expectation_type,
            {k: _text(k, v) for k, v in r.kwargs.items() if v is not None},
        )
        for r in rules
    ]
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    frame = spark.createDataFrame([(name, rows)], f"name STRING, expectations {EXPECTATIONS}")
    return frame.select("name", (stamp if created_at is None else created_at).alias("created_at"), "expectations")


def _text(key: str, value: object) -> str:
    """A parameter as it is kept. Value sets are kept as JSON lists, and bounds as the number they were read as, so that neither is
    read a second time as something else."""
    if key == "value_set":
        value = read_parameter(key, value)
    return str(value) if isinstance(value, (str, Decimal)) else json.dumps(value)


def _value(key: str, text: str | None) -> object:
    """A parameter as rules take it: :func:`_text` undone, and texts that came from elsewhere read as in a form."""
    if text is None:
        return None
    if key == "value_set" and text.startswith("["):
        try:
            listed = json.loads(text)
        except ValueError:
            listed = None
        if isinstance(listed, list):
            return listed
    return read_parameter(key, text)
