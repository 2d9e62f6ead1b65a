"""Column helpers shared by the operators; every one of them stays inside the JVM."""

from plumbline.functions.columns import groupable, positional, resolve_column
from plumbline.functions.numbers import percent_half_up, rate_half_even
from plumbline.functions.text import contains_ignore_case, strip

__all__ = [
    "contains_ignore_case",
    "groupable",
    "percent_half_up",
    "positional",
    "rate_half_even",
    "resolve_column",
    "strip",
]
