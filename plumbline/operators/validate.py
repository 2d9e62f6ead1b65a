"""Evaluate a suite of rules on a dataset."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import positional, resolve_column
from plumbline.functions.numbers import rate_half_even
from plumbline.functions.text import text_literal
from plumbline.operators.rules import CHECK_RESULT, Check, Rule, bind_all
from plumbline.plans.fused import Measures, in_order, literal_rows, struct_sql, unpack
from plumbline.plans.grouped import DEFAULT_COLUMNS_PER_SCAN, scan_width, value_counts
from plumbline.plans.sums import column_means, column_sums
from plumbline.sources.spec import SourceSpec, reads_whole_rows, resolve, settled, source_label

# Aggregates computed by one pass. Beyond 100 columns Spark leaves whole-stage
# code generation (twice as slow for 160 ranges); wider suites make several
# passes, each over the columns of its own rules.
MEASURES_PER_SCAN = 90

WARNINGS = "pos INT, column STRING, suggestion STRING, message STRING"


def validate(
    df: DataFrame,
    rules: Sequence[Rule],
    columns_per_scan: int | None = DEFAULT_COLUMNS_PER_SCAN,
    measures_per_scan: int = MEASURES_PER_SCAN,
) -> DataFrame:
    """One row per rule, in order (schema ``CHECK_RESULT``).

    All rules on single values and counts share one aggregation of the dataset, and those
    on means another; uniqueness rules take grouped ones. Nothing runs until the result
    is used.
    """
    return _evaluate(df, _bound(df, rules), columns_per_scan, measures_per_scan)


def validate_source(
    spark: SparkSession, source: SourceSpec, rules: Sequence[Rule], isolated: bool = False
) -> DataFrame:
    """Validate a source, with as many uniqueness rules per scan as suits how it
    is read."""
    source = settled(spark, source)
    run = validate_isolated if isolated else validate
    return run(resolve(spark, source), rules, columns_per_scan=scan_width(reads_whole_rows(source)))


def validate_isolated(
    df: DataFrame,
    rules: Sequence[Rule],
    columns_per_scan: int | None = DEFAULT_COLUMNS_PER_SCAN,
    measures_per_scan: int = MEASURES_PER_SCAN,
) -> DataFrame:
    """As :func:`validate`, but a rule whose evaluation breaks (say, on a column
    whose computation fails for some row) becomes a failed row with the message,
    and the other rules still get their verdicts.

    Runs the rules at once, together; only after a failure are first the columns and
    then the rules of one column halved until the culprits stand alone. Only finished
    result rows reach the driver.
    """
    rows = _isolate(df, _bound(df, rules), columns_per_scan, measures_per_scan)
    return df.sparkSession.createDataFrame(rows, CHECK_RESULT).coalesce(1).sortWithinPartitions("pos")


def validate_many(
    datasets: Mapping[str, DataFrame], rules: Sequence[Rule], isolated: bool = False
) -> DataFrame:
    """The same rules on several datasets; ``source_label`` tells them apart."""
    run = validate_isolated if isolated else validate
    if not datasets:
        raise ValueError("no datasets given")
    parts = [
        run(df, rules).select(F.lit(label).alias("source_label"), "*")
        for label, df in datasets.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _bound(df: DataFrame, rules: Sequence[Rule]) -> list[Check]:
    if not rules:
        raise ValueError("the suite has no rules")
    return bind_all(rules, df.schema, df.sparkSession)


def validate_observed(
    df: DataFrame, rules: Sequence[Rule], path: str, mode: str = "errorifexists", measures_per_scan: int = MEASURES_PER_SCAN
) -> DataFrame:
    """Write ``df`` to ``path`` as Parquet, and return what :func:`validate` says of it.

    Rules on values and counts are settled by metrics that the write itself collects: the source is computed once,
    and nothing is read for them. Means and uniqueness need groups; they are read back, their columns alone, from what has been written.
    Rows that ``mode="append"`` finds in place already are no part of the verdict, so suites with such rules cannot be appended.
    """
    checks = _bound(df, rules)
    open_ = [c for c in checks if not c.settled]
    plain = [c for c in open_ if not c.by_value and not c.by_sum]
    if mode == "append" and len(plain) < len(open_):
        raise ValueError("means and uniqueness of appended rows cannot be told from those that are there")
    flat, watched = positional(df), []
    for chunk in chunks(plain, measures_per_scan):
        measures = Measures()
        structs = [c.row(measures) for c in chunk]
        seen = Observation()
        flat = flat.observe(seen, *measures.columns)
        watched.append((seen, structs))
    flat.toDF(*df.columns).write.mode(mode).parquet(path)
    rows = [c.row(Measures()) for c in checks if c.settled]
    parts = [(_as_row(df.sparkSession, seen.get), structs) for seen, structs in watched]
    if rows:
        parts.append((df.sparkSession.range(0, 1, 1, 1), rows))
    if grouped := [c for c in open_ if c.by_value or c.by_sum]:
        written = df.sparkSession.read.schema(df.schema).parquet(path)
        parts.append((_evaluate(written, grouped, DEFAULT_COLUMNS_PER_SCAN, measures_per_scan), []))
    return in_order([unpack(row, structs) if structs else row for row, structs in parts], "pos")


def _as_row(spark: SparkSession, metrics: Mapping[str, int]) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(*[F.lit(value).cast("bigint").alias(name) for name, value in metrics.items()])


def _evaluate(df: DataFrame, checks: Sequence[Check], columns_per_scan: int | None, measures_per_scan: int) -> DataFrame:
    flat = positional(df)
    parts: list[tuple[DataFrame, list[str]]] = []
    open_ = [c for c in checks if not c.settled]
    for chunk in chunks([c for c in open_ if not c.by_value and not c.by_sum], measures_per_scan):
        parts.append(measured(flat, chunk))
    if by_sum := [c for c in open_ if c.by_sum]:
        parts.append(measured(column_means(column_sums(df, _positions(by_sum))), by_sum))
    if by_value := [c for c in open_ if c.by_value]:
        parts.append(measured(value_counts(df, _positions(by_value), columns_per_scan), by_value))
    settled = [c.row(Measures()) for c in checks if c.settled]
    if not parts:
        return literal_rows(df.sparkSession, settled).sortWithinPartitions("pos")
    parts[0][1].extend(settled)
    return in_order([unpack(row, structs) for row, structs in parts], "pos")


def measured(rows: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, list[str]]:
    """The aggregates the checks need over ``rows``, and their result rows as structs."""
    measures = Measures()
    structs = [c.row(measures) for c in checks]
    return measures.over(rows), structs


def _positions(checks: Sequence[Check]) -> list[int]:
    return sorted({c.position for c in checks})


def chunks(checks: Sequence[Check], limit: int) -> list[list[Check]]:
    """Split by column, so that a column is scanned by as few passes as possible."""
    chunks: list[list[Check]] = []
    measures = Measures()
    for check in sorted(checks, key=lambda c: (-1 if c.position is None else c.position, c.pos)):
        check.row(measures)
        if not chunks or measures.slots > limit:
            chunks.append([])
            measures = Measures()
            check.row(measures)
        chunks[-1].append(check)
    return chunks


def _isolate(df: DataFrame, checks: Sequence[Check], columns_per_scan: int | None, measures_per_scan: int) -> list[tuple]:
    try:
        # At most one row per rule.
        return [tuple(r) for r in _evaluate(df, checks, columns_per_scan, measures_per_scan).collect()]
    except PySparkException as problem:
        condition = _of_a_row(problem)
        if condition is None:
            raise
        if len(checks) == 1:
            return [checks[0].failed(condition)]
    # What is wrong with data belongs to a column: first the columns apart, then the rules of one.
    columns = sorted({-1 if c.position is None else c.position for c in checks})
    if len(columns) > 1:
        upper = set(columns[len(columns) // 2 :])
        halves = [[c for c in checks if ((-1 if c.position is None else c.position) in upper) == side] for side in (False, True)]
    else:
        halves = [checks[: len(checks) // 2], checks[len(checks) // 2 :]]
    return [row for half in halves for row in _isolate(df, half, columns_per_scan, measures_per_scan)]


def _of_a_row(problem: PySparkException) -> str | None:
    """The condition of an error that comes from evaluating a row: a data exception (SQLSTATE class 22)
    or one that a query raises itself (P0001 and the like). Anything else, such as an unreadable
    file or a lost cluster, says nothing about the data, and there is no condition."""
    try:
        state, condition = problem.getSqlState(), problem.getCondition()
    except Exception:  # a Python-side error without a JVM counterpart
        return None
    if state and condition and state[:2] in ("22", "P0"):
        return condition
    found = re.search(r"\[([A-Z][A-Z0-9_.]+)\][^\n]*SQLSTATE: (22|P0)", str(problem))
    return found.group(1) if found else None


def missing_column_warnings(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule that names a column the dataset does not have under
    exactly that name, with the name that differs in case only as a suggestion."""
    rows = [
        struct_sql(
            {
                "pos": str(pos),
                "column": text_literal(name),
                "suggestion": text_literal(suggestion),
                "message": text_literal(missing_column_message(name, suggestion)),
            }
        )
        for pos, name, suggestion in missing_columns(df.columns, rules)
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], WARNINGS)
    return literal_rows(df.sparkSession, rows)


def missing_columns(columns: Sequence[str], rules: Sequence[Rule]) -> list[tuple[int, str, str | None]]:
    named = [(pos, r.kwargs.get("column")) for pos, r in enumerate(rules)]
    return [
        (pos, name, resolve_column(name, columns))
        for pos, name in named
        if isinstance(name, str) and name and name not in columns
    ]


def missing_column_message(name: str, suggestion: str | None) -> str:
    hint = f"; did you mean '{suggestion}'?" if suggestion else ""
    return f"column '{name}' not found{hint}"


def run_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of result rows, per run when ``by`` names the run's columns."""
    passed = F.coalesce(F.count_if("success"), F.lit(0))
    counts = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), passed.alias("passed"), (F.count(F.lit(1)) - passed).alias("failed")
    )
    return counts.withColumn("success_rate", rate_half_even(F.col("passed"), F.col("total")))


def run_status(summary: DataFrame) -> DataFrame:
    """Add the band a success rate falls in."""
    rate = F.col("success_rate")
    band = F.when(rate == 100, "success").when(rate >= 80, "warn").otherwise("danger")
    return summary.withColumn("band", band)


def run_report(
    df: DataFrame,
    suite_name: str,
    rules: Sequence[Rule],
    source_type: str,
    source_label: str,
    run_id: str,
    run_time: Column | None = None,
    isolated: bool = False,
    columns_per_scan: int | None = DEFAULT_COLUMNS_PER_SCAN,
) -> DataFrame:
    """The run as one nested row: what was checked, the warnings, the totals and
    the results in rule order (as many as the suite has rules). With ``isolated``, a rule
    that breaks on the data is a failed result and the report still comes."""
    fields = ", ".join(f"`{f.name}`" for f in CHECK_RESULT.fields)
    results = (validate_isolated if isolated else validate)(df, rules, columns_per_scan)
    folded = results.selectExpr(
        "count(1) AS total",
        "count_if(success) AS passed",
        f"sort_array(collect_list(struct({fields}))) AS results",
    )
    warnings = [
        struct_sql({"column": text_literal(name), "message": text_literal(missing_column_message(name, hint))})
        for _, name, hint in missing_columns(df.columns, rules)
    ]
    columns = ", ".join(text_literal(c) for c in sorted(set(df.columns)))
    return folded.select(
        F.lit(run_id).alias("run_id"),
        F.lit(suite_name).alias("suite_name"),
        F.lit(source_type).alias("source_type"),
        F.lit(source_label).alias("source_label"),
        F.expr(f"array({columns}) AS available_columns"),
        (F.current_timestamp() if run_time is None else run_time).alias("run_time"),
        F.expr(f"CAST(array({', '.join(warnings)}) AS array<struct<column:string,message:string>>) AS warnings"),
        F.struct(
            "total",
            "passed",
            (F.col("total") - F.col("passed")).alias("failed"),
            rate_half_even(F.col("passed"), F.col("total")).alias("success_rate"),
        ).alias("summary"),
        "results",
    )


def report_source(
    spark: SparkSession,
    source: SourceSpec,
    suite_name: str,
    rules: Sequence[Rule],
    run_id: str,
    run_time: Column | None = None,
    isolated: bool = True,
) -> DataFrame:
    """The report of a suite on a source: type, label (of the file that is read) and scan width are the source's."""
    source = settled(spark, source)
    return run_report(
        resolve(spark, source),
        suite_name,
        rules,
        source.type,
        source_label(source),
        run_id,
        run_time,
        isolated,
        scan_width(reads_whole_rows(source)),
    )
