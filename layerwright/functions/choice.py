"""Expressions that pick one of several values: labels, bands, the column of a year."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from layerwright.spec import CodeList


def _first_match(cases: Iterable[tuple[Column, Column]], default: Column) -> Column:
    chain = reduce(lambda done, case: done.when(*case), cases, F)
    return chain.otherwise(default)


def label(c: Column, codes: CodeList) -> Column:
    """Label of a code; NULL and unlisted codes get the list's ``other``."""
    return _first_match(((c == k, F.lit(v)) for k, v in codes.labels.items()), F.lit(codes.other))


def band(c: Column, edges: tuple[float, ...]) -> Column:
    """Number of the band a score falls in; an edge belongs to the band above it.

    A score that is NULL or at least the last edge is in the top band, so fill NULLs first.
    """
    return _first_match(((c < edge, F.lit(n)) for n, edge in enumerate(edges)), F.lit(len(edges)))


def value_for_year(year: Column, columns: dict[int, str], missing: str = "zero") -> Column:
    """The column that belongs to the row's year.

    A year without a column gives 0, or NULL with ``missing="null"``. The latter also reads a
    target of 0 as "no target": silver fills missing targets with 0.
    """
    if missing not in ("zero", "null"):
        raise ValueError(f"missing must be 'zero' or 'null', not {missing!r}")
    keep = (lambda c: c) if missing == "zero" else (lambda c: F.nullif(c, F.lit(0.0)))
    other = F.lit(0.0) if missing == "zero" else F.lit(None).cast("double")
    return _first_match(((year == y, keep(F.col(c))) for y, c in columns.items()), other)
