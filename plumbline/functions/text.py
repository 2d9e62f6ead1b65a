"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
# Spark's plain trim() removes only U+0020.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: texts that read as a finite number, digits may be grouped by
# single underscores. Stricter than a Spark cast, which also takes '1d' or '1f'.
NUMBER_PATTERN = (
    r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
)
# Fixed value: texts that read as an infinity or not-a-number, in any case.
SPECIAL_NUMBER_PATTERN = r"(?i)^[+-]?(inf|infinity|nan)$"


def text_literal(value: str | None) -> str:
    """SQL text of a string constant. Spelled in hexadecimal, so that no quoting
    or escaping rule applies to what is in it."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return f"CAST(X'{value.encode().hex()}' AS STRING)"


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def contains_ignore_case(text: Column, needle: str) -> Column:
    """Literal, case-insensitive substring test; a NULL text holds nothing."""
    return F.lower(F.coalesce(text, F.lit(""))).contains(needle.lower())


def number_or_null(text: Column) -> Column:
    """The number a text spells, or NULL."""
    bare = strip(text)
    special = F.lower(F.regexp_replace(bare, r"^[+-]", ""))
    sign = F.when(bare.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(
            bare.rlike(NUMBER_PATTERN),
            F.regexp_replace(bare, "_", "").try_cast("double"),
        )
        .when(
            bare.rlike(SPECIAL_NUMBER_PATTERN),
            sign * F.when(special == "nan", F.lit(float("nan"))).otherwise(F.lit(float("inf"))),
        )
    )
