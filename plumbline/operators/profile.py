"""Column profiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import column_position, groupable, positional
from plumbline.functions.numbers import percent_half_up
from plumbline.functions.text import text_literal
from plumbline.operators.profile_states import profile_from_states, profile_state
from plumbline.plans.fused import Measures, literal_rows, struct_sql, unpack
from plumbline.plans.grouped import DEFAULT_COLUMNS_PER_SCAN, scan_width, value_counts
from plumbline.plans.sums import GATHERED, binned, column_means, column_sums, piece_sums, rounded
from plumbline.sources.spec import SourceSpec, reads_whole_rows, resolve, settled

# A column with a larger share of NULLs (in percent) is flagged.
NULL_ALERT_ABOVE = 20

# Columns that share one aggregate row where no grouping is needed: up to six
# aggregates each, and at most 100 aggregate columns keep code generation.
_COLUMNS_PER_AGGREGATE = 16


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column: one scan, no shuffle but of one row per task."""
    return _named(df, _side_by_side(df, _positions(df, columns), lambda c, _: {"nulls": _nulls(c)}), "nulls")


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Minimum, maximum and mean of the numeric columns; NULL when there is no value."""
    fields = df.schema.fields
    chosen = [p for p in _positions(df, columns) if isinstance(fields[p].dataType, T.NumericType)]
    if not chosen:
        raise ValueError("no numeric columns")
    found = column_means(column_sums(df, chosen))
    # Columns without a value keep a row.
    nothing = [struct_sql({"pos": str(p), **{c: "CAST(NULL AS DOUBLE)" for c in ("min", "max", "mean")}}) for p in chosen]
    every = found.select("pos", "min", "max", "mean").unionByName(literal_rows(df.sparkSession, nothing))
    return _named(df, every.groupBy("pos").agg(*[F.max(c).alias(c) for c in ("min", "max", "mean")]), "min", "max", "mean")


def distinct_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    columns_per_scan: int | None = DEFAULT_COLUMNS_PER_SCAN,
) -> DataFrame:
    """Exact number of distinct values per column, NULL being one of them; NULL
    for columns whose values cannot be grouped."""
    return profile(df, columns, columns_per_scan).select("pos", "column", "unique")


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    columns_per_scan: int | None = DEFAULT_COLUMNS_PER_SCAN,
    exact: bool = True,
) -> DataFrame:
    """One row per column: type, NULLs, distinct values, rows, and for numeric
    columns minimum, maximum and mean.

    Exact profiles derive everything from the counts per distinct value, so the
    dataset is read once, ``columns_per_scan`` columns at a time. Let all columns
    share a scan (None) when reading is expensive whatever is selected (CSV,
    JSON, a query). Texts of over 63 bytes, arrays, structs and maps are told apart by SHA-256.

    ``exact=False`` estimates the distinct counts (to a percent or two) and shuffles
    one small row per task instead of the distinct values.
    """
    positions = _positions(df, columns)
    fields = df.schema.fields
    countable = [p for p in positions if exact and groupable(fields[p].dataType)]
    rest = [p for p in positions if p not in countable]
    parts = []
    if countable:
        parts.append(_from_counts(df, countable, columns_per_scan))
    if rest:
        parts.append(_without_counts(df, rest, estimate=not exact))
    stats = reduce(DataFrame.unionByName, parts)
    named = _named(df, stats, "nulls", "unique", "total", "min", "max", "mean", types=True)
    return named.coalesce(1).sortWithinPartitions("pos")


def profile_source(spark: SparkSession, source: SourceSpec, exact: bool = True) -> DataFrame:
    """Profile a source, with as many columns per scan as suits how it is read."""
    source = settled(spark, source)
    width = scan_width(reads_whole_rows(source))
    return profile(resolve(spark, source), columns_per_scan=width, exact=exact)


def with_percentages(profiled: DataFrame) -> DataFrame:
    """Add the shares of NULLs and of distinct values, and the NULL alert."""
    return profiled.withColumns(
        {
            "null_pct": percent_half_up(F.col("nulls"), F.col("total")),
            "unique_pct": percent_half_up(F.col("unique"), F.col("total")),
        }
    ).withColumn("null_alert", F.col("null_pct") > NULL_ALERT_ABOVE)


def dataset_summary(df: DataFrame, label: str) -> DataFrame:
    """Rows, columns, NULLs over all columns, and the format as the label shows
    it (what follows the last dot, in capitals)."""
    flat = positional(df)
    nulls = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in flat.columns)
    shown = text_literal((label or "csv").split(".")[-1].upper())
    return flat.selectExpr(
        "count(1) AS rows",
        f"{len(df.columns)} AS columns",
        f"coalesce(sum({nulls}), 0) AS total_nulls",
        f"{shown} AS format",
    )


def _positions(df: DataFrame, columns: Sequence[str] | None) -> list[int]:
    if columns is None:
        return list(range(len(df.columns)))
    found = [column_position(c, df.columns) for c in columns]
    if None in found:
        raise ValueError(f"no such column: {columns[found.index(None)]}")
    return sorted(set(found))


def _named(df: DataFrame, stats: DataFrame, *values: str, types: bool = False) -> DataFrame:
    """Replace positions by names (and types) of the columns."""

    def lookup(texts: Sequence[str]) -> str:
        return f"element_at(array({', '.join(text_literal(t) for t in texts)}), pos + 1)"

    labels = [f"{lookup(df.columns)} AS column"]
    if types:
        labels.append(f"{lookup([t for _, t in df.dtypes])} AS type")
    return stats.selectExpr("pos", *labels, *values)


def _from_counts(df: DataFrame, positions: Sequence[int], columns_per_scan: int | None) -> DataFrame:
    # Columns of an empty table have no counted value; an n of 0 keeps them.
    nothing = [
        struct_sql(
            {
                "pos": str(p),
                "is_null": "CAST(NULL AS BOOLEAN)",
                "value": "CAST(NULL AS DOUBLE)",
                "n": "CAST(0 AS BIGINT)",
            }
        )
        for p in positions
    ]
    counts = value_counts(df, positions, columns_per_scan).unionByName(literal_rows(df.sparkSession, nothing))
    partial = {
        "nulls": "sum(IF(is_null, n, 0))",
        "unique": "count_if(n > 0)",
        "total": "sum(n)",
        "low": "min(value)",
        "high": "max(value)",
        "present": "sum(IF(value IS NULL, 0, n))",
        **piece_sums("n"),
    }
    merged = {
        "nulls": "sum(nulls)",
        "unique": "sum(unique)",
        "total": "sum(total)",
        "min": "min(low)",
        "max": "max(high)",
        "present": "sum(present)",
        "bins": GATHERED,
    }
    by_bin = binned(counts).groupBy("pos", "bin").agg(*[F.expr(f"{sql} AS {name}") for name, sql in partial.items()])
    gathered = by_bin.groupBy("pos").agg(*[F.expr(f"{sql} AS {name}") for name, sql in merged.items()])
    stats = rounded(gathered, "bins", "summed")
    return stats.withColumn("mean", F.try_divide("summed", "present")).drop("summed", "present")


def _nulls(column: str) -> str:
    return f"count(CASE WHEN {column} IS NULL THEN 1 END)"


def _without_counts(df: DataFrame, positions: Sequence[int], estimate: bool) -> DataFrame:
    """Statistics of columns whose distinct values are not counted exactly."""
    found = profile_from_states(profile_state(df, positions, quantiles=False))
    return found.withColumn("unique", F.col("unique") if estimate else F.lit(None).cast("bigint")).drop("column", "type")


def _side_by_side(
    df: DataFrame,
    positions: Sequence[int],
    aggregates: Callable[[str, T.DataType], dict[str, str]],
) -> DataFrame:
    """Aggregates per column, computed side by side in one row and turned into
    one row per column: ``(pos, ...)``."""
    flat, fields = positional(df), df.schema.fields
    parts = []
    for start in range(0, len(positions), _COLUMNS_PER_AGGREGATE):
        measures = Measures()
        structs = [
            struct_sql(
                {
                    "pos": str(p),
                    **{
                        name: sql if sql.startswith("CAST(NULL") else measures.need(sql)
                        for name, sql in aggregates(f"c{p}", fields[p].dataType).items()
                    },
                }
            )
            for p in positions[start : start + _COLUMNS_PER_AGGREGATE]
        ]
        parts.append(unpack(measures.over(flat), structs))
    return reduce(DataFrame.unionByName, parts)
