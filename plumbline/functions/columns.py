"""Column names and column types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.functions.canonical import canonical_text


def resolve_column(name: str, columns: Sequence[str]) -> str | None:
    """The column ``name`` stands for: an exact match, else one that differs in
    case only (the last such column), else None."""
    position = column_position(name, columns)
    return None if position is None else columns[position]


def column_position(name: str, columns: Sequence[str]) -> int | None:
    """Position of the column that :func:`resolve_column` finds."""
    if name in columns:
        return list(columns).index(name)
    folded = [c.lower() for c in columns]
    if name.lower() not in folded:
        return None
    return len(folded) - 1 - folded[::-1].index(name.lower())


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed to c0, c1, ...

    Operators address columns by position, so names with dots, names that need
    quoting and names that differ only in case are all safe. The rename is a
    projection that Catalyst folds into the scan: pruning is unaffected.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def groupable(dtype: T.DataType) -> bool:
    """Whether values of the type can be told apart: by grouping, or by a text of their own (variants have neither)."""
    if canonical_text("c", dtype) is not None:
        return True
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return groupable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(groupable(f.dataType) for f in dtype.fields)
    return True
