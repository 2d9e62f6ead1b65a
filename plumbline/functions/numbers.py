"""Rounding rules of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_half_up(part: Column, whole: Column) -> Column:
    """Whole-number percentage, halves rounded up; 0 when ``whole`` is 0."""
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(F.floor(share * F.lit(100.0) + F.lit(0.5)), F.lit(0).cast("bigint"))


def rate_half_even(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, halves rounded to even; 0 when ``whole`` is 0.

    The division comes first: ``part * 100 / whole`` rounds differently for some
    pairs of counts.
    """
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(F.bround(share * F.lit(100.0), 1), F.lit(0.0))
