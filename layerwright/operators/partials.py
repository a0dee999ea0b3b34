"""Aggregates kept in a form that adds up: those of new rows join those of earlier ones, whose rows are not read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerwright.functions import half_up


def moments(value: Column) -> Column:
    """Aggregate of a group's known values: their number, their sum and the sum of their squared distances from the mean."""
    n = F.count(value)
    spread = F.coalesce(F.var_pop(value) * n, F.lit(0.0))
    return F.struct(n.alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), spread.alias("spread"))


def _added(name: str) -> Column:
    """Moments of groups together: each group's own spread, and how far the groups' means lie apart."""
    n, total, spread = (F.col(f"{name}.{part}") for part in ("n", "total", "spread"))
    around_zero = lambda t, count: F.coalesce(F.try_divide(t * t, count), F.lit(0.0))
    apart = F.sum(around_zero(total, n)) - around_zero(F.sum(total), F.sum(n))
    return F.struct(F.sum(n).alias("n"), F.sum(total).alias("total"), (F.sum(spread) + F.greatest(apart, F.lit(0.0))).alias("spread"))


def merged(parts: DataFrame, keys: tuple[str, ...], counts: tuple[str, ...], measured: tuple[str, ...] = ()) -> DataFrame:
    """One row a key from any number of partial rows: counts and moments added up, combined before the shuffle."""
    sums = [F.sum(c).alias(c) for c in counts]
    return parts.groupBy(*keys).agg(*sums, *(_added(m).alias(m) for m in measured))


def mean_of(name: str, digits: int = 2) -> Column:
    """The rounded mean; NULL without a value."""
    return half_up(F.try_divide(F.col(f"{name}.total"), F.col(f"{name}.n")), digits)


def deviation_of(name: str, digits: int = 2) -> Column:
    """The rounded sample standard deviation; NULL for fewer than two values."""
    n = F.col(f"{name}.n")
    return half_up(F.when(n > 1, F.sqrt(F.col(f"{name}.spread") / (n - 1))), digits)
