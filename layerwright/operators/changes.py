"""What became of each key between two deliveries of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerwright.functions import count_where

HASH = "_record_hash"
NEW, CHANGED, GONE, SAME = "new", "changed", "gone", "same"


def _side(df: DataFrame, key: tuple[str, ...], digest: str, later: bool) -> DataFrame:
    return df.select(*key, F.col(digest).alias("_digest"), F.lit(later).alias("_later"))


def _summary(later: Column) -> dict[str, Column]:
    """What tells the rows of a key apart, however many there are: their number and, of their hashes, the first, the last and a sum."""
    digest = F.when(later, F.col("_digest"))
    return {"n": count_where(later), "least": F.min(digest), "most": F.max(digest), "mixed": F.bit_xor(F.when(later, F.xxhash64("_digest")))}


def changes(before: DataFrame, after: DataFrame, key: tuple[str, ...], digest: str = HASH, same: bool = False) -> DataFrame:
    """The keys of two deliveries with ``change``: new, changed or gone, and with ``same`` also those that stayed as they were.

    One aggregation over the keys and hashes of both, combined before the shuffle: no other column is read, and a key's copies
    are one row a task. A key changed if the hashes of its rows did, or how often they occur. NULL is a key.
    """
    both = _side(before, key, digest, False).unionByName(_side(after, key, digest, True))
    sides = {"b": ~F.col("_later"), "a": F.col("_later")}
    found = both.groupBy(*key).agg(*(c.alias(f"_{s}_{name}") for s, rows in sides.items() for name, c in _summary(rows).items()))
    summary = lambda side: F.struct(*(F.col(f"_{side}_{name}").alias(name) for name in _summary(F.lit(True))))
    change = (
        F.when(F.col("_b_n") == 0, NEW)
        .when(F.col("_a_n") == 0, GONE)
        .when(summary("b").eqNullSafe(summary("a")), SAME)
        .otherwise(CHANGED)
    )
    told = found.select(*key, change.alias("change"))
    return told if same else told.where(F.col("change") != SAME)
