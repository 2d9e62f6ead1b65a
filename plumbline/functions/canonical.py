"""One text for each value, whatever its type, so that nested values can be told apart by a digest of fixed width.

Equal values have equal texts and different ones different texts: parts of arrays, structs and
maps are preceded by their length or kept apart by a character they cannot hold, NULLs inside have a mark of
their own, entries of maps are sorted, -0.0 is 0.0 and all NaNs are one.
"""

from __future__ import annotations

from pyspark.sql import types as T

_NULL = "'N'"


def canonical_text(column: str, dtype: T.DataType, depth: int = 0) -> str | None:
    """SQL of the text; NULL for NULL. None for types without one (variants, intervals, collated texts)."""
    x = f"x{depth}"
    if dtype == T.StringType():
        return column
    if isinstance(dtype, T.BinaryType):
        return f"hex({column})"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # -0.0 and 0.0 are one value.
        return f"CAST({column} + CAST(0 AS {dtype.simpleString()}) AS STRING)"
    if isinstance(dtype, T.TimestampType):
        # A local time may occur twice.
        return f"CAST(unix_micros({column}) AS STRING)"
    if isinstance(dtype, (T.IntegralType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampNTZType)):
        return f"CAST({column} AS STRING)"
    if isinstance(dtype, T.ArrayType):
        part = _part(x, dtype.elementType, depth + 1)
        return part and f"array_join(transform({column}, {x} -> {part}), '')"
    if isinstance(dtype, T.StructType):
        parts = [_part(f"{column}.`{f.name.replace('`', '``')}`", f.dataType, depth) for f in dtype.fields]
        if None in parts:
            return None
        return f"CASE WHEN {column} IS NOT NULL THEN concat('', {', '.join(parts) or chr(39) * 2}) END"
    if isinstance(dtype, T.MapType):
        key, value = _part(f"{x}.key", dtype.keyType, depth + 1), _part(f"{x}.value", dtype.valueType, depth + 1)
        if key is None or value is None:
            return None
        return f"array_join(array_sort(transform(map_entries({column}), {x} -> concat({key}, {value}))), '')"
    return None


def _part(value: str, dtype: T.DataType, depth: int) -> str | None:
    """A value inside another one: its text ends where the next one begins. Never NULL."""
    text = canonical_text(value, dtype, depth)
    if text is None:
        return None
    if dtype == T.StringType() or isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return f"coalesce(concat(octet_length({text}), ':', {text}), {_NULL})"
    return f"concat(coalesce({text}, {_NULL}), ',')"


def digest(text: str) -> str:
    """SQL of the 32 bytes that stand for a text; NULL for NULL."""
    return f"unhex(sha2(CAST({text} AS BINARY), 256))"
