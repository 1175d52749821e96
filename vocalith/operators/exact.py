"""Sums and means of decimal digits, which no order of summing changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(c: Column, digits: int) -> Column:
    """The sum of values to so many digits, as a whole number of units of the last one: no order of summing changes it."""
    return F.sum(F.round(c * 10.0**digits).cast("decimal(20,0)"))


def rounded(total: Column, parts: Column, digits: int) -> Column:
    """total / parts, both whole numbers, rounded once (half away from zero) to a double of so many digits; null if parts is 0 or null."""
    up = (2 * F.abs(total) + parts).cast("decimal(38,0)")
    whole = F.call_function("div", up, F.when(parts > 0, 2 * parts).cast("decimal(38,0)"))
    return F.when(total < 0, -whole).otherwise(whole) / 10.0**digits


def exact_mean(c: Column, digits: int = 6) -> Column:
    """The mean of values to 12 digits, rounded once, so that neither binary halves nor the order of the sum matter."""
    return rounded(exact_sum(c, 12), F.count(c).cast("decimal(20,0)") * 10 ** (12 - digits), digits)
