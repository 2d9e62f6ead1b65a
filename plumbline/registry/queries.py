"""Queries over the test tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import catalog, catalog_index, history, preview, profile, rule_states, suites, validate
from plumbline.operators.profile_states import profile_from_states, read_profile_states, write_profile_state
from plumbline.operators.rules import Rule
from plumbline.registry.inputs import (
    catalog_objects,
    orders_dirty,
    orders_suite,
    run_reports,
    suite_objects,
    table,
)
from plumbline.sources import SourceSpec, file_inventory, read_path, resolve, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- sources ------------------------------------------------------------------


@query
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "customer.CSV")
    table(spark, sf_dir, "customer").write.csv(path, header=True)
    return read_path(spark, path)


@query
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(spark, SourceSpec("local", "lineitem.parquet", {"root": sf_dir}))


@query
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events.jsonl")
    table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("string")).write.json(path)
    return read_path(spark, path)


@query
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sizes are not known to SQL, only that there is one.
    listed = file_inventory(spark, sf_dir, active=f"{sf_dir}/orders.parquet")
    return listed.select("name", "ext", (F.col("size_kb") > 0).alias("has_size"), "active", "bucket")


@query
def sql_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    text = """
        SELECT c_mktsegment, o_orderstatus, count(*) AS orders,
               min(o_totalprice) AS lowest, max(o_totalprice) AS highest
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_mktsegment, o_orderstatus
    """
    return resolve(spark, SourceSpec("sql", text, {"tables": tables}))


@query
def sql_source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    text = """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
               c_name, c_nationkey, c_acctbal, c_mktsegment
        FROM orders JOIN customer ON o_custkey = c_custkey
    """
    return profile.profile_source(spark, SourceSpec("sql", text, {"tables": tables}))


# -- preview and profile ------------------------------------------------------


@query
def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "part.json")
    table(spark, sf_dir, "part").write.json(path)
    return preview.columns(read_path(spark, path))


@query
def preview_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return preview.preview(orders, 10, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview.row_count(table(spark, sf_dir, "lineitem"))


@query
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_counts(orders_dirty(spark, sf_dir))


@query
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_counts(table(spark, sf_dir, "documents"))


@query
def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric_stats(orders_dirty(spark, sf_dir))


@query
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(orders_dirty(spark, sf_dir))


@query
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "lineitem"))


@query
def profile_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "embeddings"))


@query
def profile_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = profile.with_percentages(profile.profile(orders_dirty(spark, sf_dir)))
    return profiled.select("column", "null_pct", "unique_pct", "null_alert")


def _against_exact(estimated: DataFrame, dataset: DataFrame) -> DataFrame:
    """Whether the estimated distinct counts are within 3 % of the exact ones; all else as it is."""
    exact = profile.distinct_counts(dataset).select("pos", F.col("unique").alias("exact"))
    close = F.abs(F.col("unique") - F.col("exact")) <= 0.03 * F.col("exact")
    return estimated.join(exact, "pos").withColumn("within_3_percent", close).drop("unique", "exact")


@query
def profile_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    return _against_exact(profile.profile(lineitem, exact=False), lineitem)


@query
def profile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One state for each of the parts that a dataset may grow by.
    lineitem, path = table(spark, sf_dir, "lineitem"), scratch_path(spark, "states")
    for line in range(1, 8):
        part = lineitem.filter(F.col("l_linenumber") == line) if line < 7 else lineitem.filter("l_linenumber >= 7")
        write_profile_state(part, path, f"line_{line}")
    return _against_exact(profile_from_states(read_profile_states(spark, path)), lineitem)


@query
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_summary(orders_dirty(spark, sf_dir), "orders.parquet")


# -- rules --------------------------------------------------------------------


def _rule_query(name: str, *rules: tuple[str, dict]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        suite = [Rule.parse(kind, kwargs) for kind, kwargs in rules]
        results = validate.validate(orders_dirty(spark, sf_dir), suite)
        return results.drop("kwargs", "status", "expectation_type")

    run.__name__ = name
    query(run)


_rule_query(
    "rule_column_exists",
    ("expect_column_to_exist", {"column": "price"}),
    ("expect_column_to_exist", {"column": "PRICE"}),
    ("expect_column_to_exist", {"column": "cost"}),
    ("expect_column_to_exist", {}),
    ("expect_column_values_to_not_be_null", {"column": "PRICE"}),
)
_rule_query(
    "rule_not_null",
    ("expect_column_values_to_not_be_null", {"column": "o_orderkey"}),
    ("expect_column_values_to_not_be_null", {"column": "status"}),
    ("expect_column_values_to_not_be_null", {"column": "status", "mostly": 0.5}),
    ("expect_column_values_to_not_be_null", {"column": "cost"}),
)
_rule_query(
    "rule_unique",
    ("expect_column_values_to_be_unique", {"column": "o_orderkey"}),
    ("expect_column_values_to_be_unique", {"column": "custbucket"}),
    ("expect_column_values_to_be_unique", {"column": "price", "mostly": 0.9}),
    ("expect_column_values_to_be_unique", {"column": "cost"}),
)
_rule_query(
    "rule_between",
    ("expect_column_values_to_be_between", {"column": "price", "min_value": "0", "max_value": "1000000"}),
    ("expect_column_values_to_be_between", {"column": "price", "min_value": "1000", "max_value": "400000"}),
    ("expect_column_values_to_be_between", {"column": "custbucket", "min_value": "0", "max_value": "", "strict_min": True}),
    ("expect_column_values_to_be_between", {"column": "status", "min_value": "0", "max_value": "1"}),
    ("expect_column_values_to_be_between", {"column": "price", "min_value": "2", "max_value": "1"}),
    ("expect_column_values_to_be_between", {"column": "price", "min_value": "", "max_value": ""}),
    ("expect_column_values_to_be_between", {"column": "price", "min_value": "low", "max_value": "1"}),
)
_rule_query(
    "rule_regex",
    ("expect_column_values_to_match_regex", {"column": "prio", "regex": "^[1-5]-"}),
    ("expect_column_values_to_match_regex", {"column": "prio", "regex": "^[1-3]-"}),
    ("expect_column_values_to_match_regex", {"column": "prio", "regex": "^[1-3]-", "mostly": 0.5}),
    ("expect_column_values_to_match_regex", {"column": "custbucket", "regex": "9"}),
    ("expect_column_values_to_match_regex", {"column": "prio", "regex": "["}),
)
_rule_query(
    "rule_in_set",
    ("expect_column_values_to_be_in_set", {"column": "status", "value_set": "O, F"}),
    ("expect_column_values_to_be_in_set", {"column": "status", "value_set": ["O"]}),
    ("expect_column_values_to_be_in_set", {"column": "custbucket", "value_set": ["1", "x"]}),
    ("expect_column_values_to_be_in_set", {"column": "custbucket", "value_set": list(range(50)), "mostly": 0.25}),
    ("expect_column_values_to_be_in_set", {"column": "status"}),
)
_rule_query(
    "rule_row_count",
    ("expect_table_row_count_to_be_between", {"min_value": "1", "max_value": "1e15"}),
    ("expect_table_row_count_to_be_between", {"min_value": "", "max_value": "10"}),
    ("expect_table_row_count_to_be_between", {"min_value": "", "max_value": ""}),
)
_rule_query(
    "rule_mean",
    ("expect_column_mean_to_be_between", {"column": "price", "min_value": "200000", "max_value": "300000"}),
    ("expect_column_mean_to_be_between", {"column": "price", "min_value": "0", "max_value": "1000"}),
    ("expect_column_mean_to_be_between", {"column": "custbucket", "min_value": "10", "max_value": ""}),
    ("expect_column_mean_to_be_between", {"column": "prio", "min_value": "10", "max_value": ""}),
)


# -- suites -------------------------------------------------------------------


@query
def validate_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(orders_dirty(spark, sf_dir), orders_suite())


def _lineitem_rules() -> list[Rule]:
    return [
        Rule.parse("expect_table_row_count_to_be_between", {"min_value": 1, "max_value": ""}),
        Rule.parse("expect_column_values_to_not_be_null", {"column": "l_orderkey"}),
        Rule.parse("expect_column_values_to_not_be_null", {"column": "l_shipdate"}),
        Rule.parse("expect_column_values_to_be_between", {"column": "l_quantity", "min_value": 1, "max_value": 50}),
        Rule.parse("expect_column_values_to_be_between", {"column": "l_discount", "min_value": 0, "max_value": 0.05}),
        Rule.parse("expect_column_values_to_be_in_set", {"column": "l_returnflag", "value_set": "A,N,R"}),
        Rule.parse("expect_column_values_to_be_in_set", {"column": "l_linestatus", "value_set": "O"}),
        Rule.parse("expect_column_values_to_match_regex", {"column": "l_shipdate", "regex": "^19[0-9]{2}-"}),
        Rule.parse("expect_column_mean_to_be_between", {"column": "l_quantity", "min_value": 20, "max_value": 30}),
        Rule.parse("expect_column_values_to_be_unique", {"column": "l_extendedprice"}),
        Rule.parse("expect_column_values_to_be_unique", {"column": "l_linenumber"}),
    ]


@query
def validate_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(table(spark, sf_dir, "lineitem"), _lineitem_rules())


@query
def validate_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_observed(table(spark, sf_dir, "lineitem"), _lineitem_rules(), scratch_path(spark, "lineitem.parquet"))


#: Rows of one file of the folder that stream_validate reads.
STREAM_FILE_ROWS = 1_000_000


@query
def stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table as a folder of files that a stream takes two at a time; files of bounded rows, so that
    # neither the writing tasks nor a micro-batch read more as the table grows.
    lineitem, source = table(spark, sf_dir, "lineitem"), scratch_path(spark, "incoming")
    lineitem.write.option("maxRecordsPerFile", STREAM_FILE_ROWS).parquet(source)
    stream = spark.readStream.schema(lineitem.schema).option("maxFilesPerTrigger", 2).parquet(source)
    states = scratch_path(spark, "states")
    rule_states.stream_validate(stream, _lineitem_rules(), states, scratch_path(spark, "progress")).awaitTermination()
    return rule_states.stream_results(spark, states, _lineitem_rules(), lineitem.schema)


@query
def validate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        Rule.parse("expect_column_values_to_be_unique", {"column": "doc_id"}),
        Rule.parse("expect_column_values_to_be_unique", {"column": "text"}),
        Rule.parse("expect_column_values_to_match_regex", {"column": "text", "regex": "[a-z]@[a-z]", "mostly": 0.01}),
        Rule.parse("expect_column_values_to_be_in_set", {"column": "lang", "value_set": "en, fr, de, es"}),
        Rule.parse("expect_column_values_to_be_between", {"column": "n_chars", "min_value": 20, "max_value": ""}),
        Rule.parse("expect_column_mean_to_be_between", {"column": "n_chars", "min_value": 1, "max_value": 1e6}),
    ]
    return validate.validate(table(spark, sf_dir, "documents"), rules)


@query
def validate_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A computed column that fails for some of the rows.
    rank = F.when(F.col("o_orderpriority") == "5-LOW", F.raise_error(F.lit("no rank"))).otherwise(1)
    broken = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", rank.cast("int").alias("rank")
    )
    rules = [
        Rule("expect_column_values_to_not_be_null", {"column": "o_orderkey"}),
        Rule("expect_column_values_to_be_between", {"column": "rank", "min_value": 1, "max_value": 5}),
        Rule("expect_column_values_to_be_between", {"column": "o_totalprice", "min_value": 1000}),
        Rule("expect_column_values_to_be_sorted", {"column": "o_orderkey"}),
        Rule("expect_column_values_to_be_unique", {"column": "O_ORDERKEY"}),
        Rule("expect_column_values_to_not_be_null", {"column": "o_orderkey", "severity": "high"}),
    ]
    return validate.validate_isolated(broken, rules).drop("kwargs", "observed")


@query
def validate_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = {f"{n}.parquet": table(spark, sf_dir, n) for n in ("customer", "supplier", "nation")}
    rules = [
        Rule.parse("expect_table_row_count_to_be_between", {"min_value": 100, "max_value": ""}),
        Rule.parse("expect_column_values_to_be_unique", {"column": "C_Custkey"}),
        Rule.parse("expect_column_mean_to_be_between", {"column": "s_acctbal", "min_value": 0, "max_value": 9000}),
    ]
    return validate.validate_many(datasets, rules).drop("kwargs")


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.run_summary(validate.validate(orders_dirty(spark, sf_dir), orders_suite()))


@query
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = history.history_results(run_reports(spark, sf_dir))
    return validate.run_status(validate.run_summary(results, by=["source_label"]))


@query
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = validate.run_report(
        orders_dirty(spark, sf_dir),
        "orders_quality",
        orders_suite(),
        "local",
        "orders.parquet",
        run_id="run_1",
        run_time=F.to_timestamp(F.lit("2024-01-01 00:00:00")),
    )
    return report.select(
        "run_id",
        "suite_name",
        "source_type",
        "source_label",
        F.array_join("available_columns", ",").alias("available_columns"),
        F.array_join(F.col("warnings.message"), ";").alias("warnings"),
        "summary.*",
        F.array_join(F.col("results.status"), ",").alias("statuses"),
    )


@query
def suite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = suites.suite_rules(suites.suites_from_json(suite_objects(spark, sf_dir), "value"))
    return rules.select("suite", "pos", "expectation_type", F.col("kwargs")["column"].alias("column"))


@query
def suite_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suites.suite_sizes(suites.suites_from_json(suite_objects(spark, sf_dir), "value"))


@query
def suite_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = suites.suite_rules(suites.suites_from_json(suite_objects(spark, sf_dir), "value"))
    return suites.suite_params(rules).withColumn("items", F.array_join("items", "|"))


@query
def suite_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = suites.suite_rules(suites.suites_from_json(suite_objects(spark, sf_dir), "value"))
    return suites.suite_warnings(rules, table(spark, sf_dir, "orders"))


@query
def suite_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = suites.suites_from_json(suite_objects(spark, sf_dir), "value")
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("suite_"), F.col("p_partkey").cast("string"))
    # New suites for the parts of one size; every second name is already taken.
    requests = part.filter("p_size = 7").select(
        F.when(F.col("p_partkey") % 2 == 0, name).otherwise(F.concat(F.lit(" new_"), name, F.lit(" "))).alias("name"),
        F.lit("2024-02-01T00:00:00").alias("created_at"),
    )
    created = suites.create_suites(current, requests)
    added = suites.add_rules(
        created,
        part.select(
            name.alias("suite"),
            F.lit(1).alias("seq"),
            F.when(F.col("p_partkey") % 2 == 0, "expect_column_to_exist").otherwise("expect_a_miracle").alias("expectation_type"),
            F.create_map(F.lit("column"), F.col("p_name")).alias("kwargs"),
        ),
    )
    removed = suites.remove_rules(added, part.select(name.alias("suite"), F.lit(0).alias("pos")))
    remaining = suites.delete_suites(removed, part.filter("p_size = 9").select(name.alias("name")))
    return suites.suite_rules(remaining, keep_empty=True).select(
        "suite", "pos", "expectation_type", F.col("kwargs")["column"].alias("column")
    )


# -- history ------------------------------------------------------------------


@query
def history_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    history.append_runs(run_reports(spark, sf_dir), path)
    rows = history.history_results(history.read_runs(spark, path))
    return rows.select(
        "run_id", "suite_name", "source_label", "success_rate", "pos", "expectation_type", "success", "status"
    )


@query
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = history.latest_runs(run_reports(spark, sf_dir))
    return latest.select("run_id", "suite_name", "source_label", "summary.*")


@query
def history_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, runs = scratch_path(spark, "runs"), run_reports(spark, sf_dir)
    # The newest half of the year comes first, then all that is older.
    recent = F.month("run_time") > 6
    for part in (runs.filter(recent), runs.filter(~recent)):
        history.append_runs(part.coalesce(8), path)
    return history.newest_runs(spark, path).select("run_id", "suite_name", "source_label", "summary.*")


# -- catalog ------------------------------------------------------------------


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_from_json(catalog_objects(spark, sf_dir), "value")


def _flat(entries: DataFrame) -> DataFrame:
    """Arrays as texts, for comparison."""
    return entries.select(
        "name",
        "alias",
        "description",
        "owner",
        F.array_join("tags", "|").alias("tags"),
        "source_type",
        "source_ref",
        F.array_size("fields").alias("n_fields"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("created_at"),
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("updated_at"),
    )


@query
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_catalog(spark, sf_dir)).withColumn("n_fields", F.coalesce("n_fields", F.lit(-1)))


@query
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(_catalog(spark, sf_dir), text="RED").select("name", "alias", "owner", "description")


@query
def catalog_search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    # "%" and "." are characters here, not patterns.
    found = catalog.search(_catalog(spark, sf_dir), text="0% OF type ec")
    return found.select("name", "description")


@query
def catalog_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.search(_catalog(spark, sf_dir), text="brand#1", tag=" SIZE 1 ")
    return found.select("name", "owner", F.array_join("tags", "|").alias("tags"))


def _posted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The catalog and its postings, as a later search reads them."""
    entries, path = _catalog(spark, sf_dir), scratch_path(spark, "postings")
    catalog_index.write_postings(entries, path)
    return entries, spark.read.parquet(path)


@query
def catalog_search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog_index.search_postings(*_posted(spark, sf_dir), text="RED")
    return found.select("name", "alias", "owner", "description")


@query
def catalog_tag_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog_index.search_postings(*_posted(spark, sf_dir), text="brand#1", tag=" SIZE 1 ")
    return found.select("name", "owner", F.array_join("tags", "|").alias("tags"))


@query
def catalog_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _catalog(spark, sf_dir)
    odd = F.substring("name", -1, 1).isin("1", "3", "5", "7", "9")
    messy = raw.withColumns(
        {
            "name": F.when(odd, F.concat(F.lit(" \t"), F.col("name"), F.lit("\n"))).otherwise(F.lit("  ")),
            "alias": F.concat(F.lit("\u3000"), F.col("alias"), F.lit(" ")),
            "tags": F.concat(F.array(F.lit(" "), F.lit("\ta b ")), F.col("tags")),
            "fields": F.concat(
                F.col("fields"),
                F.array(F.struct(F.lit(" "), F.lit("x"), F.lit("y"), F.lit(False))).cast(catalog.FIELDS),
            ),
        }
    )
    return _flat(catalog.normalize(messy))


@query
def catalog_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _catalog(spark, sf_dir)
    key = F.col("p_partkey").cast("string")
    # One name per brand, so many requests compete for each; size 1 reuses names
    # that exist already.
    requests = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") == 1, F.concat(F.lit("part_"), key)).otherwise(F.col("p_brand")).alias("name"),
        F.concat(F.lit("part "), key).alias("alias"),
        F.lit(None).cast("string").alias("description"),
        F.col("p_name").alias("owner"),
        F.array(F.col("p_type")).alias("tags"),
        F.lit("local").alias("source_type"),
        F.lit("").alias("source_ref"),
        F.lit(None).cast(catalog.FIELDS).alias("fields"),
        F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, p_partkey) AS created_at"),
    )
    added = catalog.create(current, requests)
    return _flat(added).filter("source_ref = ''")


@query
def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size")
    # Two updates for every entry with an even key: the later one leaves the
    # owner alone. Names of odd keys do not exist.
    first = table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("part_"), key)).otherwise(F.concat(F.lit("lost_"), key)).alias("name"),
        F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("changed_at"),
        F.lit(" early ").alias("alias"),
        F.lit(None).cast("string").alias("description"),
        F.when(size % 3 == 0, F.lit(" Ops ")).alias("owner"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.lit(None).cast("string").alias("source_type"),
        F.lit(None).cast("string").alias("source_ref"),
        F.lit(None).cast(catalog.FIELDS).alias("fields"),
    )
    second = first.withColumns(
        {
            "changed_at": F.lit("2024-03-02 00:00:00").cast("timestamp_ntz"),
            "alias": F.lit("late"),
            "owner": F.lit(None).cast("string"),
            "tags": F.array(F.lit(" x "), F.lit("")),
        }
    )
    return _flat(catalog.merge(_catalog(spark, sf_dir), first.unionByName(second)))


@query
def catalog_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "part").filter(F.col("p_size") > 10).select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name")
    )
    return catalog.delete(_catalog(spark, sf_dir), gone).select("name", "alias")


@query
def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.described_fields(_catalog(spark, sf_dir))


@query
def catalog_autofill(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    filled = catalog.autofill(_catalog(spark, sf_dir), part, "part.parquet")
    return catalog.described_fields(filled)


# Keys as they are known in the inventory.
QUERIES["file_inventory"] = QUERIES.pop("file_listing")
QUERIES["profile"] = QUERIES.pop("profile_orders")
