"""Exact decimals: rounding on store, and products of ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, SHARES, WEIGHT, PERCENT, PRICE, RATIO = "decimal(20,2)", "decimal(20,4)", "decimal(9,6)", "decimal(28,6)", "decimal(20,8)", "decimal(20,10)"


def divided(numerator: Column, by: Column, places: int) -> Column:
    """A quotient rounded half up; null where the divisor is zero or null. Twelve digits or more stand behind the point before rounding."""
    return F.round(numerator.cast("decimal(26,6)") / F.nullif(by.cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)")), places)


def percent(part: Column, whole: Column) -> Column:
    """Part times 100 over whole, six places."""
    return divided(part.cast("decimal(20,4)") * 100, whole, 6)
