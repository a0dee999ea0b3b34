from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layerwright.operators.lookup import broadcast_limit, matches, prefixed
from layerwright.sources.workspace import Staged, stage

Key = tuple[str, ...]


@dataclass(frozen=True)
class Repeats:
    """Row and key counts of a table, and the keys that occur more than once."""

    total_rows: int
    distinct_keys: int
    keys: Staged

    @property
    def duplicates(self) -> int:
        return self.total_rows - self.distinct_keys


def find_repeats(df: DataFrame, key: Key) -> Repeats:
    """Count rows and keys and write down the repeated keys, in one pass over the key columns."""
    seen = Observation()
    counts = (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"))
        .observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("keys"))
    )
    repeated = stage(counts.where("n > 1").select(*key), "repeated-keys")
    found = seen.get
    return Repeats(found["total"], found["keys"], repeated)


def first_per_key(df: DataFrame, key: Key) -> DataFrame:
    """Keep the first row of each key, by the order of all other columns.

    The order is total, so the result does not depend on partitioning or retries. Spark limits the
    window to its first row before the shuffle too: however many copies a key has, each task
    sends at most one of them.
    """
    others = (c for c in df.columns if c not in key)
    first = W.partitionBy(*key).orderBy(*(F.col(c).asc_nulls_first() for c in others))
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def dedup_by_key(df: DataFrame, key: Key, repeats: Repeats | None = None) -> DataFrame:
    """The rows of ``first_per_key``, shuffling only rows whose key occurs more than once.

    Rows of unrepeated keys, mostly nearly all, stay where they are. Repeated keys too many to
    broadcast are met by a shuffle of the whole table.
    """
    repeats = repeats or find_repeats(df, key)
    if repeats.keys.rows == 0:
        return df
    if repeats.keys.hashed_bytes > broadcast_limit(df.sparkSession):
        return first_per_key(df, key)
    repeated = F.broadcast(prefixed(repeats.keys.df, key, "_r_"))
    same = matches(key, "_r_", null_safe=True)
    alone = df.join(repeated, same, "left_anti")
    return alone.unionAll(first_per_key(df.join(repeated, same, "left_semi"), key))
