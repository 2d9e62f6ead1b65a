"""The eight rule types.

A rule becomes a :class:`Check`: either an error found by looking at the schema
and the parameters alone, or aggregates to compute and the verdict as an expression
over them. Errors are settled before anything runs, because checks
share a job and one failing expression would take the others with it.

Settled here, where the rule names leave room:

* NULLs never violate a value rule other than not-null, and do not count in its
  denominator; NaN is a value outside every range;
* a regular expression matches when it is found anywhere in the value;
* every member of a group of duplicates is unexpected;
* a blank bound is no bound; a range without bounds or with min > max is an error.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_CEILING, ROUND_FLOOR, Context, Decimal, InvalidOperation

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from plumbline.functions.columns import column_position, groupable
from plumbline.functions.text import text_literal
from plumbline.plans.fused import Measures, struct_sql

# Rule types and their parameters.
RULE_TYPES: dict[str, tuple[str, ...]] = {
    "expect_column_to_exist": ("column",),
    "expect_column_values_to_not_be_null": ("column",),
    "expect_column_values_to_be_unique": ("column",),
    "expect_column_values_to_be_between": ("column", "min_value", "max_value"),
    "expect_column_values_to_match_regex": ("column", "regex"),
    "expect_column_values_to_be_in_set": ("column", "value_set"),
    "expect_table_row_count_to_be_between": ("min_value", "max_value"),
    "expect_column_mean_to_be_between": ("column", "min_value", "max_value"),
}

RULE_DESCRIPTIONS: dict[str, str] = {
    "expect_column_to_exist": "the dataset has the column",
    "expect_column_values_to_not_be_null": "no value is NULL",
    "expect_column_values_to_be_unique": "no value occurs twice",
    "expect_column_values_to_be_between": "every number is within the range, bounds included",
    "expect_column_values_to_match_regex": "the pattern is found in every value",
    "expect_column_values_to_be_in_set": "every value is one of the given ones",
    "expect_table_row_count_to_be_between": "the number of rows is within the range, bounds included",
    "expect_column_mean_to_be_between": "the mean is within the range, bounds included",
}

# Further parameters a rule takes.
_OPTIONS: dict[str, tuple[str, ...]] = {
    "expect_column_values_to_not_be_null": ("mostly",),
    "expect_column_values_to_be_unique": ("mostly",),
    "expect_column_values_to_be_between": ("mostly", "strict_min", "strict_max"),
    "expect_column_values_to_match_regex": ("mostly",),
    "expect_column_values_to_be_in_set": ("mostly",),
    "expect_column_mean_to_be_between": ("strict_min", "strict_max"),
}

CHECK_RESULT = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("expectation_type", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("kwargs", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("observed", T.DoubleType()),
        T.StructField("element_count", T.LongType()),
        T.StructField("unexpected_count", T.LongType()),
    ]
)


def _as_float(value: object, otherwise: object) -> object:
    try:
        return float(value)
    except (TypeError, ValueError):
        return otherwise


def _read_bound(given: object) -> object:
    """A number; nothing for a blank text; what is no number stays, to be reported.

    Numbers are floats. Those that a float cannot hold stay whole or decimal numbers.
    """
    bare = given.strip() if isinstance(given, str) else given
    if bare is None or bare == "":
        return None
    try:
        near = float(bare)
    except OverflowError:
        near = math.inf if bare > 0 else -math.inf
    except (TypeError, ValueError):
        return given
    if isinstance(bare, float):
        return near
    try:
        exact = Decimal(bare)
    except (InvalidOperation, TypeError, ValueError):
        return near
    if not exact.is_finite() or math.isfinite(near) and Decimal(repr(near)) == exact:
        return near
    return int(exact) if exact.adjusted() <= 400 and exact == exact.to_integral_value() else exact


def _read_members(given: object) -> object:
    """A list; a text is one with commas between, its members trimmed."""
    return given if given is None or isinstance(given, list) else re.split(r"\s*,\s*", str(given).strip())


#: How the parameters that need reading are read.
_READERS: dict[str, Callable[[object], object]] = {
    "min_value": _read_bound,
    "max_value": _read_bound,
    "value_set": _read_members,
}


def read_parameter(key: str, given: object) -> object:
    """The value of a parameter that may come from a form."""
    return _READERS[key](given) if key in _READERS else given


@dataclass(frozen=True)
class Rule:
    expectation_type: str
    kwargs: Mapping[str, object] = field(default_factory=dict)

    @classmethod
    def parse(cls, expectation_type: str, kwargs: Mapping[str, object]) -> Rule:
        """A rule from form parameters; unknown rule types are rejected."""
        if expectation_type not in RULE_TYPES:
            raise ValueError(f"unknown rule type: {expectation_type!r}")
        return cls(expectation_type, {k: read_parameter(k, v) for k, v in kwargs.items()})


class RuleError(ValueError):
    """A rule that cannot be evaluated on this schema."""


@dataclass(frozen=True)
class Verdict:
    """Outcome of a rule, as SQL over computed aggregates."""

    success: str
    observed: str | None = None
    elements: str | None = None
    unexpected: str | None = None


@dataclass(frozen=True)
class Check:
    """A rule bound to a schema."""

    pos: int
    rule: Rule
    column: str | None
    kwargs: str
    position: int | None = None
    error: str | None = None
    verdict: Callable[[Measures], Verdict] | None = None
    by_value: bool = False  # needs the counts per distinct value
    by_sum: bool = False  # needs the column's exact sum

    @property
    def settled(self) -> bool:
        """Known without data: an error, or a rule on the schema."""
        return self.verdict is None or self.rule.expectation_type == "expect_column_to_exist"

    def row(self, measures: Measures) -> str:
        """The result row as a struct over the aggregates that ``measures``
        collects."""
        verdict = Verdict("FALSE") if self.verdict is None else self.verdict(measures)
        values = {
            "pos": str(self.pos),
            "expectation_type": text_literal(self.rule.expectation_type),
            "column": text_literal(self.column),
            "kwargs": text_literal(self.kwargs),
            "success": f"coalesce({verdict.success}, FALSE)",
            "status": f"IF({verdict.success}, 'passed', 'failed')",
            "error": text_literal(self.error),
            "observed": verdict.observed,
            "element_count": verdict.elements,
            "unexpected_count": verdict.unexpected,
        }
        return struct_sql(
            {
                f.name: f"CAST({values[f.name] or 'NULL'} AS {f.dataType.simpleString()})"
                for f in CHECK_RESULT.fields
            }
        )

    def failed(self, message: str) -> tuple:
        """The result row of a rule whose evaluation broke."""
        kind = self.rule.expectation_type
        return (self.pos, kind, self.column, self.kwargs, False, "failed", message, None, None, None)


def bind(pos: int, rule: Rule, schema: T.StructType, spark: SparkSession) -> Check:
    """Check a rule against a schema without touching the data."""
    kind, kwargs = rule.expectation_type, dict(rule.kwargs)
    name, position = kwargs.get("column"), None
    if isinstance(name, str) and name:
        position = column_position(name, schema.names)
        if position is not None:
            name = kwargs["column"] = schema.names[position]
    else:
        name = None if name is None else str(name)
    check = Check(
        pos, rule, name, json.dumps(kwargs, ensure_ascii=False, default=str), position
    )
    try:
        verdict = _verdict(kind, kwargs, position, schema, spark)
    except RuleError as problem:
        return Check(check.pos, rule, name, check.kwargs, position, error=str(problem))
    return Check(
        check.pos,
        rule,
        name,
        check.kwargs,
        position,
        verdict=verdict,
        by_value=kind == "expect_column_values_to_be_unique",
        by_sum=kind == "expect_column_mean_to_be_between",
    )


def _verdict(
    kind: str,
    kwargs: Mapping[str, object],
    position: int | None,
    schema: T.StructType,
    spark: SparkSession,
) -> Callable[[Measures], Verdict]:
    if kind not in RULE_TYPES:
        raise RuleError(f"unsupported rule type: {kind}")
    known = (*RULE_TYPES[kind], *_OPTIONS.get(kind, ()))
    unknown = sorted(set(kwargs) - set(known))
    if unknown:
        raise RuleError(f"unknown parameter: {', '.join(unknown)}")
    if kind == "expect_table_row_count_to_be_between":
        bounds = _Bounds.of(kwargs)
        return lambda m: _row_count(m, bounds)
    if not kwargs.get("column"):
        raise RuleError("missing parameter: column")
    if kind == "expect_column_to_exist":
        found = position is not None
        return lambda m: Verdict("TRUE" if found else "FALSE")
    if position is None:
        raise RuleError(f"no such column: {kwargs['column']}")
    dtype = schema.fields[position].dataType
    column, mostly = f"c{position}", _mostly(kwargs)
    if kind == "expect_column_values_to_not_be_null":
        return lambda m: _tolerant(_row_total(m), _nulls(m, position), mostly)
    if kind == "expect_column_values_to_be_unique":
        if not groupable(dtype):
            raise RuleError(f"uniqueness is not defined for type {dtype.simpleString()}")
        return lambda m: _unique(m, position, mostly)
    if kind == "expect_column_values_to_match_regex":
        if isinstance(dtype, T.VariantType):
            raise RuleError("a regular expression is not defined for type variant")
        pattern = text_literal(_pattern(kwargs, spark))
        return lambda m: _scalar(m, position, f"NOT CAST({column} AS STRING) RLIKE {pattern}", mostly)
    if kind == "expect_column_values_to_be_in_set":
        members = ", ".join(_members(kwargs, dtype))
        # A value set may hold NULLs, and "not IN" is then NULL for a stranger.
        inside = f"coalesce({column} IN ({members}), FALSE)" if members else "FALSE"
        return lambda m: _scalar(m, position, f"{column} IS NOT NULL AND NOT {inside}", mostly)
    if not isinstance(dtype, T.NumericType):
        raise RuleError(f"not a numeric column: {kwargs['column']} ({dtype.simpleString()})")
    bounds = _Bounds.of(kwargs)
    if kind == "expect_column_mean_to_be_between":
        return lambda m: _mean(m, position, bounds)
    outside = f"NOT ({bounds.hold_in(column, dtype)})"
    return lambda m: _scalar(m, position, outside, mostly)


# -- parameters ---------------------------------------------------------------


@dataclass(frozen=True)
class _Bounds:
    low: float | int | Decimal | None
    high: float | int | Decimal | None
    above: bool = False  # low itself is outside
    below: bool = False  # high itself is outside

    @classmethod
    def of(cls, kwargs: Mapping[str, object]) -> _Bounds:
        low, high = _bound(kwargs, "min_value"), _bound(kwargs, "max_value")
        if low is None and high is None:
            raise RuleError("min_value and max_value are both absent")
        if low is not None and high is not None and low > high:
            raise RuleError(f"min_value {low} is greater than max_value {high}")
        return cls(low, high, _flag(kwargs, "strict_min"), _flag(kwargs, "strict_max"))

    def hold(self, value: str) -> str:
        """Whether a DOUBLE is within the bounds; NULL for NULL."""
        tests = []
        if self.low is not None:
            low = _double(self.low, up=True)
            tests.append(f"{value} {'>' if self.above and low == self.low else '>='} {_number(low)}")
        if self.high is not None:
            high = _double(self.high, up=False)
            tests.append(f"{value} {'<' if self.below and high == self.high else '<='} {_number(high)}")
        # NaN sorts above every number, so a lower bound alone lets it pass.
        return " AND ".join([*tests, f"NOT isnan({value})"])

    def hold_in(self, value: str, dtype: T.DataType) -> str:
        """Whether a number of the type is within the bounds; NULL for NULL. Whole and decimal numbers
        are compared as such: as doubles, large neighbours would be one."""
        if isinstance(dtype, T.IntegralType):
            digits, scale, cast = 19, 0, "BIGINT"
        elif isinstance(dtype, T.DecimalType):
            digits, scale, cast = dtype.precision, dtype.scale, dtype.simpleString()
        else:
            return self.hold(f"CAST({value} AS DOUBLE)")
        tests = [f"{value} IS NOT NULL"]
        for bound, strict, signs, rounding in (
            (self.low, self.above, (">=", ">"), ROUND_CEILING),
            (self.high, self.below, ("<=", "<"), ROUND_FLOOR),
        ):
            if bound is None:
                continue
            if bound in (math.inf, -math.inf):
                tests += [] if (bound < 0) == (rounding == ROUND_CEILING) else ["FALSE"]
                continue
            exact = bound if isinstance(bound, Decimal) else Decimal(bound if isinstance(bound, int) else repr(bound))
            edge = exact.quantize(Decimal(1).scaleb(-scale), rounding, Context(prec=1000, Emax=10**6, Emin=-(10**6)))
            most = (Decimal(10**digits - 1) if cast != "BIGINT" else Decimal(2**63 - 1)).scaleb(-scale)
            if abs(edge) > most:  # no value of the type gets that far
                tests += [] if (edge < 0) == (rounding == ROUND_CEILING) else ["FALSE"]
            else:
                tests.append(f"{value} {signs[strict and edge == exact]} CAST('{edge:f}' AS {cast})")
        # The first test is for NULL, of which nothing is known.
        return f"CASE WHEN {tests[0]} THEN {' AND '.join(tests[1:]) or 'TRUE'} END"


def _double(bound: float | int | Decimal, up: bool) -> float:
    """The double that divides the others as the bound does: the next one above a lower bound, or below an upper one."""
    try:
        near = float(bound)
    except OverflowError:
        near = math.copysign(math.inf, bound)
    if up and near < bound:
        return math.nextafter(near, math.inf)
    return math.nextafter(near, -math.inf) if not up and near > bound else near


def _number(value: float) -> str:
    if math.isinf(value):
        return "double('-Infinity')" if value < 0 else "double('Infinity')"
    return f"{value!r}D"


def _bound(kwargs: Mapping[str, object], key: str) -> float | int | Decimal | None:
    value = read_parameter(key, kwargs.get(key))
    if value is None:
        return None
    if not isinstance(value, (float, int, Decimal)):
        raise RuleError(f"{key} is not a number: {value!r}")
    if value != value:
        raise RuleError(f"{key} is not a number: nan")
    return value


def _flag(kwargs: Mapping[str, object], key: str) -> bool:
    value = kwargs.get(key)
    if value is None or isinstance(value, bool):
        return bool(value)
    if isinstance(value, str) and value.strip().lower() in ("true", "false", ""):
        return value.strip().lower() == "true"
    raise RuleError(f"{key} is not true or false: {value!r}")


def _mostly(kwargs: Mapping[str, object]) -> float | None:
    value = kwargs.get("mostly")
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    share = _as_float(value, math.nan)
    if not 0.0 <= share <= 1.0:
        raise RuleError(f"mostly is not a share between 0 and 1: {value!r}")
    return share


def _pattern(kwargs: Mapping[str, object], spark: SparkSession) -> str:
    pattern = kwargs.get("regex")
    if not isinstance(pattern, str):
        raise RuleError("missing parameter: regex")
    try:
        # Folded to a constant by the optimizer: no job is started.
        spark.sql("SELECT '' RLIKE :p AS m", args={"p": pattern}).collect()
    except PySparkException as problem:
        if "INVALID_PARAMETER_VALUE" not in (problem.getCondition() or "") and "PatternSyntax" not in str(problem):
            raise
        raise RuleError(f"invalid regular expression: {pattern}") from problem
    return pattern


def _members(kwargs: Mapping[str, object], dtype: T.DataType) -> list[str]:
    if kwargs.get("value_set") is None:
        raise RuleError("missing parameter: value_set")
    values = read_parameter("value_set", kwargs["value_set"])
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType, T.CalendarIntervalType)):
        raise RuleError(f"a value set is not defined for type {dtype.simpleString()}")
    members = []
    for value in values:
        if value is None:
            continue
        if isinstance(value, float) and value.is_integer() and isinstance(dtype, T.IntegralType):
            value = int(value)
        text = text_literal(str(value))
        # A text that is no value of the type turns to NULL and matches nothing.
        members.append(text if isinstance(dtype, T.StringType) else f"try_cast({text} AS {dtype.simpleString()})")
    return members


# -- verdicts -----------------------------------------------------------------


def _row_total(m: Measures) -> str:
    return m.need("count(1)")


def _nulls(m: Measures, position: int) -> str:
    return m.need(f"count(CASE WHEN c{position} IS NULL THEN 1 END)")


def _present(m: Measures, position: int) -> str:
    return f"({_row_total(m)} - {_nulls(m, position)})"


def _scalar(m: Measures, position: int, unexpected: str, mostly: float | None) -> Verdict:
    return _tolerant(_present(m, position), m.need(f"count(CASE WHEN {unexpected} THEN 1 END)"), mostly)


def _tolerant(elements: str, unexpected: str, mostly: float | None) -> Verdict:
    if mostly is None:
        success = f"{unexpected} = 0"
    else:
        share = f"try_divide(CAST({elements} - {unexpected} AS DOUBLE), {elements})"
        success = f"coalesce({share} >= {_number(mostly)}, TRUE)"
    return Verdict(success, elements=elements, unexpected=unexpected)


def _unique(m: Measures, position: int, mostly: float | None) -> Verdict:
    here = f"pos = {position} AND NOT is_null"
    elements = m.need(f"coalesce(sum(n) FILTER (WHERE {here}), 0)")
    unexpected = m.need(f"coalesce(sum(n) FILTER (WHERE {here} AND n > 1), 0)")
    return _tolerant(elements, unexpected, mostly)


def _row_count(m: Measures, bounds: _Bounds) -> Verdict:
    rows = _row_total(m)
    return Verdict(bounds.hold_in(rows, T.LongType()), observed=rows, elements=rows)


def _mean(m: Measures, position: int, bounds: _Bounds) -> Verdict:
    here = f"FILTER (WHERE pos = {position})"
    mean = m.need(f"max(mean) {here}")
    return Verdict(bounds.hold(mean), observed=mean, elements=m.need(f"coalesce(max(present) {here}, 0)"))


def bind_all(rules: Sequence[Rule], schema: T.StructType, spark: SparkSession) -> list[Check]:
    return [bind(pos, rule, schema, spark) for pos, rule in enumerate(rules)]
