"""Groups of rows: means per group, a group's mean on each of its rows, shares of a total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layerwright.functions import percent, rounded_mean
from layerwright.operators.lookup import ROWS, lookup_join, stage_row_counts


def group_means(df: DataFrame, keys: tuple[str, ...], means: dict[str, str], digits: int = 2) -> DataFrame:
    """Rounded mean of each source column (``means``: result name -> source column) per key."""
    return df.groupBy(*keys).agg(*(rounded_mean(c, digits).alias(out) for out, c in means.items()))


def with_target_gap(df: DataFrame, actual: str, target: str, reached: str, gap: str) -> DataFrame:
    """Add whether the target is reached (an unknown comparison counts as no) and by how much."""
    actual, target = F.col(actual), F.col(target)
    return df.select(
        "*",
        F.coalesce(actual >= target, F.lit(False)).alias(reached),
        (actual - target).alias(gap),
    )


def share_of_total(
    df: DataFrame, keys: tuple[str, ...], part: str, counted: str, count: str, share: str
) -> DataFrame:
    """Count rows with a known ``counted`` per key and part, and give each part's percentage of its key.

    The first shuffle moves one row per key and part and task; the second one only the counts. A
    key's window holds its parts, so ``part`` should have few values, such as bands.
    """
    return shares(df.groupBy(*keys, part).agg(F.count(counted).alias(count)), keys, count, share)


def shares(counts: DataFrame, keys: tuple[str, ...], count: str, share: str) -> DataFrame:
    """Each count's percentage of its key's sum; a key's window holds its rows."""
    total = F.sum(count).over(W.partitionBy(*keys))
    return (
        counts.withColumn("_total", total)
        .withColumn(share, percent(F.col(count), F.col("_total")))
        .drop("_total")
    )


def with_group_mean(df: DataFrame, keys: tuple[str, ...], value: str, out: str, digits: int = 2) -> DataFrame:
    """Put the rounded mean of a group on each of its rows.

    A window would send each group whole to one task. Here the groups are averaged first, each
    task sending one row per group, and the means are looked up. NULL keys form a group.
    """
    per_group = df.groupBy(*keys).agg(
        rounded_mean(value, digits).alias(out), F.count(F.lit(1)).alias(ROWS)
    )
    means = stage_row_counts(per_group, "group-means")
    return lookup_join(
        df,
        means.df.drop(ROWS),
        keys,
        null_safe=True,
        table_bytes=means.hashed_bytes,
        row_counts=means,
    )
