"""Aggregates over the rows of a group that meet a condition. All of them combine map-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from layerwright.functions.numbers import half_up


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def mean_where(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def stddev_where(condition: Column, value: Column) -> Column:
    """Sample standard deviation; NULL when fewer than two values qualify."""
    return F.stddev_samp(F.when(condition, value))


def rounded_mean(column: str, digits: int = 2) -> Column:
    return half_up(F.avg(column), digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; NULL when the whole is 0."""
    return half_up(F.try_divide(part, whole) * 100, digits)


def percent_or_zero(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.coalesce(percent(part, whole, digits), F.lit(0.0))
