"""Numeric conventions: half-even rounding, NaN as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_nan(x: Column) -> Column:
    """NaN means unknown: make it null so that comparisons, greatest and averages skip it."""
    return F.when(~F.isnan(x), x)


def safe_round(x: Column, digits: int = 2) -> Column:
    """Half-even rounding; text that is no number, NaN and missing give null."""
    return F.bround(missing_nan(x.try_cast("double")), digits)


def clip(x: Column, low, high) -> Column:
    """Bound a value; missing stays missing (greatest and least alone would skip the null)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null on zero."""
    return F.try_divide(a, b)
