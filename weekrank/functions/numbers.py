"""Number expressions: lenient casts, half-even rounding, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Double, or null where the text is no number (NaN counts as missing)."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def round_half_even(c: Column) -> Column:
    """Nearest whole number, ties to the even one, as a nullable long."""
    return F.bround(c, 0).cast("long")


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def bool_or_null(c: Column) -> Column:
    return c.cast("boolean")


def bool_as_double(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False)).cast("double")


def capped(c: Column, limit: float) -> Column:
    """Values above the limit become the limit; missing stays missing."""
    return F.when(c.isNotNull(), F.least(c, F.lit(limit)))
