"""Counts per distinct value, for several columns in one pass.

Distinct counts, duplicate counts and the numeric statistics of a column all
follow from "each distinct value and how often it occurs". That table is built
by grouping on one column or, so that several columns share a scan and a
shuffle, with GROUPING SETS of one set per column. Where all columns share one
scan, rows become pairs of column and value. Spark's partial aggregation runs
before the shuffle: a value that makes up a third of the table leaves each task
as one row, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.canonical import canonical_text, digest
from plumbline.functions.columns import positional

# Columns that share one scan. A scan of column-wise files reads only the columns
# it needs, so scanning k times costs no more bytes than once, while a shared scan
# makes every grouping key k columns wide: over 30 million rows with four columns,
# all with millions of values, one column per scan took half as long as
# four.
DEFAULT_COLUMNS_PER_SCAN = 1

# More scans than this cost more in planning than they save in reading: a profile
# of a wide table then takes all columns in one scan.
MOST_SCANS = 24


def scan_width(whole_rows: bool) -> int | None:
    """Columns per scan that suit how an input is read; None is all of them. What
    is read whole whatever is selected (CSV, JSON, a join) is read once."""
    return None if whole_rows else DEFAULT_COLUMNS_PER_SCAN


# Texts and blobs longer than this are grouped by their SHA-256 digest: 64 hex digits, so a shorter raw key can never be
# mistaken for one.
_LONGEST_RAW_KEY = 63


def _key(column: str, dtype: T.DataType) -> str:
    """The value to group by. Its width is bounded, so that the shuffle moves a digest per distinct document, vector
    or map rather than the thing itself."""
    if dtype == T.StringType():
        sha = f"sha2(CAST({column} AS BINARY), 256)"
    elif isinstance(dtype, T.BinaryType):
        sha = f"CAST(sha2({column}, 256) AS BINARY)"
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)) and (text := canonical_text(column, dtype)):
        return digest(text)
    else:
        return column
    return f"CASE WHEN octet_length({column}) <= {_LONGEST_RAW_KEY} THEN {column} ELSE {sha} END"


def key_text(column: str, dtype: T.DataType) -> str | None:
    """A text of at most 64 bytes that differs exactly where values of the type differ; NULL for NULL. None for types
    without one."""
    if dtype == T.StringType():
        return _key(column, dtype)
    if isinstance(dtype, T.BinaryType):
        return f"CASE WHEN octet_length({column}) <= {_LONGEST_RAW_KEY // 2} THEN hex({column}) ELSE sha2({column}, 256) END"
    text = canonical_text(column, dtype)
    nested = isinstance(dtype, (T.ArrayType, T.StructType, T.MapType))
    return f"sha2(CAST({text} AS BINARY), 256)" if text and nested else text


def value_counts(
    df: DataFrame,
    positions: Sequence[int],
    columns_per_scan: int | None = DEFAULT_COLUMNS_PER_SCAN,
) -> DataFrame:
    """One row per column and distinct value: ``(pos, is_null, value, n)``.

    ``value`` is the value as DOUBLE for numeric columns and NULL otherwise; NULL
    counts as a value of its own. An empty table has no rows here either.

    Without ``columns_per_scan``, or where it would take more than ``MOST_SCANS``
    scans, one scan serves all columns but those whose values have no text of
    their own (intervals and the like), which are grouped one by one.
    """
    if not positions:
        raise ValueError("no columns to count")
    if columns_per_scan is not None and columns_per_scan < 1:
        raise ValueError("columns_per_scan must be at least 1")
    fields = df.schema.fields
    flat = positional(df)
    parts = []
    width = columns_per_scan
    if width is None or len(positions) > MOST_SCANS * width:
        paired = {p: key for p in positions if (key := key_text(f"c{p}", fields[p].dataType))}
        if paired:
            parts.append(_pair_counts(flat, fields, paired))
        positions, width = [p for p in positions if p not in paired], 1
    chunks = [positions[i : i + width] for i in range(0, len(positions), width)]
    parts += [_chunk_counts(flat, fields, c) for c in chunks]
    return reduce(DataFrame.unionByName, parts)


def _pair_counts(flat: DataFrame, fields: Sequence[T.StructField], keys: Mapping[int, str]) -> DataFrame:
    pairs = [
        f"struct({p} AS pos, {key} AS key, {_as_double(f'c{p}', fields[p].dataType)} AS value)"
        for p, key in keys.items()
    ]
    grouped = flat.selectExpr(f"inline(array({', '.join(pairs)}))").groupBy("pos", "key", "value")
    return grouped.agg(F.expr("count(1) AS n")).selectExpr("pos", "key IS NULL AS is_null", "value", "n")


def _chunk_counts(flat: DataFrame, fields: Sequence[T.StructField], chunk: Sequence[int]) -> DataFrame:
    names = [f"k{p}" for p in chunk]
    keys = flat.selectExpr(*[f"{_key(f'c{p}', fields[p].dataType)} AS k{p}" for p in chunk])
    count = F.expr("count(1) AS n")
    if len(chunk) == 1:
        grouped = keys.groupBy(names[0]).agg(count)
        ids = None
    else:
        grouped = keys.groupingSets([[k] for k in names], *names).agg(
            count, F.expr("grouping_id() AS gid")
        )
        # grouping_id has one bit per key, first key highest, and the bit is 0 for
        # the key the set groups by.
        everything = (1 << len(chunk)) - 1
        ids = [everything ^ (1 << (len(chunk) - 1 - j)) for j in range(len(chunk))]

    def pick(values: Sequence[str]) -> str:
        if ids is None:
            return values[0]
        return "CASE gid " + " ".join(f"WHEN {g} THEN {v}" for g, v in zip(ids, values)) + " END"

    return grouped.selectExpr(
        f"{pick([str(p) for p in chunk])} AS pos",
        f"{pick([f'{k} IS NULL' for k in names])} AS is_null",
        f"{pick([_as_double(k, fields[p].dataType) for k, p in zip(names, chunk)])} AS value",
        "n",
    )


def _as_double(name: str, dtype: T.DataType) -> str:
    return f"CAST({name if isinstance(dtype, T.NumericType) else 'NULL'} AS DOUBLE)"
