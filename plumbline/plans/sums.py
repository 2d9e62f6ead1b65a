"""Sums of doubles that do not depend on the order of their rows.

A double is an integer times a power of two. Values of about the same size share a
*bin*, whose unit divides all of them, so that each is a whole number of units
below 2**62. Its four pieces of 16 bits are summed as integers: sums of parts of
the data merge without loss, in any order. Only the finished sum is rounded, once
and to the nearest double, ties to even.

There are 256 bins at most for a column, and two or three for most, so partial
aggregation leaves a few rows of each task. Exact up to 2**44 rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import positional

# Bins are 8 powers of two apart; the unit of bin 0 is the smallest double, 2**-1074.
_LOWEST = 1074
# Bins that stand for values which are no finite number.
_NAN, _PLUS, _MINUS = -1, -2, -3
# The bin of quarters, 2**-2.
_WHOLE = 134
# Digits of 8 bits that a sum may need above the bin of its largest value.
_ABOVE = 15

PIECES = ("p0", "p1", "p2", "p3")


def _scaled(value: str, exponent: str) -> str:
    """``value * 2**exponent`` in two steps, as the factor alone may leave the range of doubles."""
    return f"{value} * pow(2D, ({exponent}) div 2) * pow(2D, ({exponent}) - ({exponent}) div 2)"


def binned(rows: DataFrame, value: str = "value") -> DataFrame:
    """``rows`` with ``bin`` and the pieces of the DOUBLE column ``value``; NULL has no bin."""
    # Whole numbers need no logarithm: quarters are the unit of one of the bins.
    whole = f"{value} = rint({value}) AND abs({value}) <= 9007199254740992D"
    # The logarithm may be off by one at powers of two; units leave room for that.
    low = f"greatest(0, (CAST(floor(log2(abs({value}))) AS INT) + {_LOWEST - 53}) div 8)"
    kind = f"""CASE WHEN {value} IS NULL THEN NULL WHEN {whole} THEN {_WHOLE} WHEN isnan({value}) THEN {_NAN}
        WHEN {value} = double('Infinity') THEN {_PLUS} WHEN {value} = double('-Infinity') THEN {_MINUS} ELSE {low} END"""
    shift = f"CAST({_LOWEST} - 8 * bin AS INT)"
    near = f"{value} * CAST(shiftleft(1L, {shift}) AS DOUBLE)"
    units = f"""CASE WHEN bin IS NULL OR bin < 0 THEN 0L WHEN bin BETWEEN {_WHOLE - 7} AND {_WHOLE} THEN CAST({near} AS BIGINT)
        ELSE CAST({_scaled(value, f'{_LOWEST} - 8 * bin')} AS BIGINT) END"""
    pieces = {f"p{j}": F.expr(f"shiftright(units, {16 * j})" + (" & 65535L" if j < 3 else "")) for j in range(4)}
    return rows.withColumn("bin", F.expr(kind)).withColumn("units", F.expr(units)).withColumns(pieces).drop("units")


def piece_sums(weight: str | None = None) -> Mapping[str, str]:
    """Aggregates that add up the pieces, each times ``weight``."""
    return {p: f"sum({p}{'' if weight is None else f' * {weight}'})" for p in PIECES}


#: Aggregate that gathers the bins of one column, to be read by :func:`rounded`.
GATHERED = f"collect_list(struct(bin, {', '.join(PIECES)})) FILTER (WHERE bin IS NOT NULL)"


def rounded(sums: DataFrame, bins: str, name: str) -> DataFrame:
    """Replace the gathered ``bins`` of each row by ``name``, their sum as the nearest double.

    NULL without values; NaN with a NaN among them or infinities of both signs. Sums beyond the range of
    doubles are infinite.
    """

    def has(kind: int) -> str:
        return f"exists({bins}, b -> b.bin = {kind})"

    # Digits from the lowest bin upwards: nothing is below.
    finite = f"filter({bins}, b -> b.bin >= 0)"
    digits = f"sequence(_base, coalesce(array_max(transform({finite}, b -> b.bin)), 0) + {_ABOVE})"
    parts = " ".join(f"WHEN {2 * j} THEN b.p{j}" for j in range(4))
    weights = f"transform({digits}, d -> aggregate({finite}, 0L, (s, b) -> s + CASE d - b.bin {parts} ELSE 0L END))"

    def carried(sign: str) -> str:
        start = "named_struct('carry', 0L, 'digits', CAST(array() AS ARRAY<BIGINT>))"
        step = f"s.carry + {sign}w"
        return (
            f"aggregate(_weights, {start}, (s, w) -> named_struct('carry', shiftright({step}, 8), "
            f"'digits', concat(s.digits, array(({step}) & 255L))))"
        )

    def digit(back: int) -> str:
        return f"IF(_top < {back}, 0L, _digits[_top - {back}])"

    # The highest eight digits less one bit, with a last bit that says whether anything is below.
    head = " | ".join([f"shiftleft({digit(j)}, {55 - 8 * j})" for j in range(7)] + [f"shiftright({digit(7)}, 1)"])
    rest = f"IF({digit(7)} & 1L = 1 OR exists(slice(_digits, 1, greatest(_top - 7, 0)), x -> x <> 0), 1L, 0L)"
    total = _scaled(f"IF(_up.carry < 0, -1D, 1D) * CAST(({head}) | {rest} AS DOUBLE)", f"8 * (_base + _top - 7) + 1 - {_LOWEST}")
    result = f"""CASE WHEN size({bins}) = 0 THEN NULL WHEN {has(_NAN)} OR {has(_PLUS)} AND {has(_MINUS)} THEN double('NaN')
        WHEN {has(_PLUS)} THEN double('Infinity') WHEN {has(_MINUS)} THEN double('-Infinity')
        WHEN _top < 0 THEN 0D ELSE {total} END"""
    return (
        sums.withColumn("_base", F.expr(f"coalesce(array_min(transform({finite}, b -> b.bin)), 0)"))
        .withColumn("_weights", F.expr(weights))
        .withColumn("_up", F.expr(carried("")))
        .withColumn("_digits", F.expr(f"IF(_up.carry < 0, {carried('-')}.digits, _up.digits)"))
        .withColumn("_top", F.expr(f"array_max(transform(_digits, (x, i) -> IF(x <> 0, i, -1)))"))
        .withColumn(name, F.expr(result))
        .drop("_base", "_weights", "_up", "_digits", "_top", bins)
    )


def column_sums(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """``(pos, bin, present, low, high, p0, p1, p2, p3)`` of numeric columns: a few rows for each of them, which
    parts of the data have in common. One scan, whatever the number of columns."""
    pairs = ", ".join(f"struct({p} AS pos, CAST(c{p} AS DOUBLE) AS value)" for p in positions)
    rows = binned(positional(df).selectExpr(f"inline(array({pairs}))").filter("value IS NOT NULL"))
    parts = {"present": "count(1)", "low": "min(value)", "high": "max(value)", **piece_sums()}
    return rows.groupBy("pos", "bin").agg(*[F.expr(f"{sql} AS {name}") for name, sql in parts.items()])


def column_means(sums: DataFrame) -> DataFrame:
    """``(pos, present, min, max, mean)`` of :func:`column_sums`, also of those of several parts of the data
    together. Columns without a value have no row."""
    merged = {"present": "sum(present)", "low": "min(low)", "high": "max(high)", **piece_sums()}
    one = sums.groupBy("pos", "bin").agg(*[F.expr(f"{sql} AS {name}") for name, sql in merged.items()])
    gathered = one.groupBy("pos").agg(
        F.expr("sum(present) AS present"), F.expr("min(low) AS min"), F.expr("max(high) AS max"), F.expr(f"{GATHERED} AS bins")
    )
    return rounded(gathered, "bins", "total").selectExpr("pos", "present", "min", "max", "total / present AS mean")
