"""Mergeable profiles: what a profile needs to know of a part of the data.

The state of a part is a small table. States of parts, put together, answer as the
whole data would: counts and exact sums add up, and sketches unite. So a dataset
that grows by parts (days, files, micro-batches) is read once, part by part, and a
part that is written again just replaces its state.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.canonical import canonical_text
from plumbline.functions.columns import groupable, positional
from plumbline.functions.text import text_literal
from plumbline.operators.stores import started
from plumbline.plans.fused import Measures, struct_sql, unpack
from plumbline.plans.sums import PIECES, column_means, column_sums

_BIN = f"struct<bin:bigint,present:bigint,low:double,high:double,{','.join(f'{p}:bigint' for p in PIECES)}>"
PROFILE_STATE = (
    "pos INT, column STRING, type STRING, nulls BIGINT, total BIGINT, "
    f"sketch BINARY, quantiles BINARY, sums ARRAY<{_BIN}>"
)

# Size of the sketches of distinct values, as a power of two: errors of 0.8 % (one standard deviation), and at most
# some 16 KB for a column and part.
_SKETCH = 14
# Columns that share one aggregate row, so that a row of sketches stays small.
_COLUMNS_PER_AGGREGATE = 16


def profile_state(df: DataFrame, columns: Sequence[int] | None = None, quantiles: bool = True) -> DataFrame:
    """The state of ``df``, one row per column (schema ``PROFILE_STATE``), by default of all columns. Without ``quantiles``, their sketches are left out.

    Two scans: one for the counts and sketches, one for the sums of the numeric columns.
    """
    fields, flat = df.schema.fields, positional(df)
    chosen = list(range(len(fields))) if columns is None else list(columns)
    parts = []
    for start in range(0, len(chosen), _COLUMNS_PER_AGGREGATE):
        measures, structs = Measures(), []
        for p in chosen[start : start + _COLUMNS_PER_AGGREGATE]:
            c, dtype = f"c{p}", fields[p].dataType
            numeric = isinstance(dtype, T.NumericType)
            number = f"CAST({c} AS DOUBLE)"
            of = {
                "pos": str(p),
                "column": text_literal(fields[p].name),
                "type": text_literal(dtype.simpleString()),
                "nulls": measures.need(f"count(CASE WHEN {c} IS NULL THEN 1 END)"),
                "total": measures.need("count(1)"),
                "sketch": measures.need(f"hll_sketch_agg({told_apart(c, dtype)}, {_SKETCH})") if groupable(dtype) else "CAST(NULL AS BINARY)",
                # Quantiles are of the values that have an order among numbers.
                "quantiles": measures.need(f"kll_sketch_agg_double(CASE WHEN NOT isnan({number}) THEN {number} END)") if numeric and quantiles else "CAST(NULL AS BINARY)",
            }
            structs.append(struct_sql(of))
        parts.append(unpack(measures.over(flat), structs))
    state = reduce(DataFrame.unionByName, parts)
    numeric = [p for p in chosen if isinstance(fields[p].dataType, T.NumericType)]
    if not numeric:
        return state.withColumn("sums", F.lit(None).cast(f"array<{_BIN}>"))
    bins = f"struct(CAST(bin AS BIGINT) AS bin, present, low, high, {', '.join(PIECES)})"
    sums = column_sums(df, numeric).groupBy("pos").agg(F.expr(f"collect_list({bins}) AS sums"))
    every = state.unionByName(sums, allowMissingColumns=True)
    return every.groupBy("pos").agg(*[F.first(c, ignorenulls=True).alias(c) for c in every.columns if c != "pos"])


def told_apart(column: str, dtype: T.DataType) -> str:
    """A long, text or blob that differs where values of the type differ, for sketches; for types that sketches do not take
    it is a 64-bit hash."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"CAST({column} AS BIGINT)"
    if dtype == T.StringType() or isinstance(dtype, T.BinaryType):
        return column
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = f"{column} + CAST(0 AS {dtype.simpleString()})"
    else:
        value = canonical_text(column, dtype) or column
    return f"CASE WHEN {column} IS NOT NULL THEN xxhash64({value}) END"


def write_profile_state(df: DataFrame, path: str, part: str) -> None:
    """Keep the state of a part under its name; a state that the part has already is replaced."""
    profile_state(df).write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={part}")


def read_profile_states(spark: SparkSession, path: str) -> DataFrame:
    """The states of all parts; none before the first."""
    return started(spark, lambda: spark.read.schema(f"{PROFILE_STATE}, part STRING").parquet(path), f"{PROFILE_STATE}, part STRING")


def profile_from_states(states: DataFrame, quantiles: Sequence[float] = ()) -> DataFrame:
    """The profile of all parts together, one row per column: ``(pos, column, type, nulls, unique, total, min, max, mean)``.

    ``unique`` is an estimate, all else is exact. ``quantiles`` adds ``q`` columns, estimates as well (by rank, to about one
    percent). A column that has another type or place in some parts has a row for each.
    """
    keys = ["pos", "column", "type"]
    plain = states.groupBy(*keys).agg(
        F.sum("nulls").alias("nulls"),
        F.sum("total").alias("total"),
        F.expr("CASE WHEN count(sketch) > 0 THEN hll_sketch_estimate(hll_union_agg(sketch, true)) END AS estimate"),
        *([F.expr("kll_merge_agg_double(quantiles) AS ranks")] if quantiles else []),
    )
    # Columns of several types or places have sums apart.
    group = F.to_json(F.struct(*keys))
    sums = states.select(group.alias("pos"), F.explode("sums").alias("s")).select("pos", "s.*")
    means = column_means(sums).withColumnRenamed("pos", "group")
    joined = plain.withColumn("group", group).join(means, "group", "left")
    more = [F.expr(f"CASE WHEN kll_sketch_get_n_double(ranks) > 0 THEN kll_sketch_get_quantile_double(ranks, {q}D) END").alias(f"q{q:g}") for q in quantiles]
    return joined.select(
        *keys, "nulls", (F.col("estimate") + (F.col("nulls") > 0).cast("bigint")).alias("unique"), "total", "min", "max", "mean", *more
    )
