"""Layer tables: Parquet directories with hive partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from layerwright.sources.versions import pending


class MissingPartition(Exception):
    """A table has no rows for the partition asked for."""


def read_partition(spark: SparkSession, root: str, **values: int) -> DataFrame:
    """One partition of a layer table, by pruning; the partition columns stay in the result.

    A partition that is not there is an error: an empty table would read as a month without data. A month that was published
    counts from then on, wherever its rows still are (see ``versions``).
    """
    wanted = [F.col(c) == v for c, v in values.items()]
    found = spark.read.parquet(pending(spark, root, **values) or root).where(reduce(Column.__and__, wanted))
    if found.select(*values).isEmpty():
        which = ", ".join(f"{c}={v}" for c, v in values.items())
        raise MissingPartition(f"{root} has no rows for {which}")
    return found


def write_partitioned(
    df: DataFrame,
    path: str,
    by: tuple[str, ...],
    keep_others: bool,
    gather: bool = False,
    metrics: dict[str, Column] | None = None,
) -> dict:
    """Overwrite Parquet partitions and return the row count and metrics of what was written.

    ``keep_others`` leaves partitions that get no rows alone; without it the whole table is
    replaced. ``gather`` shuffles rows by partition value first, for few and well-sized files when
    tasks hold many values; adaptive execution cuts a value with too many rows into several tasks.
    The counts are taken after that shuffle, in the stage that writes.
    """
    seen = Observation()
    extra = [c.alias(k) for k, c in (metrics or {}).items()]
    ready = df.hint("rebalance", *by) if gather else df
    (
        ready.observe(seen, F.count(F.lit(1)).alias("rows"), *extra)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if keep_others else "static")
        .partitionBy(*by)
        .parquet(path)
    )
    return dict(seen.get)
