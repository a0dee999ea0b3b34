"""Joins of many rows to facts that are unique by key, where a few keys may have most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is crowded if it has more than this share of the rows, so there are fewer such keys than its inverse.
SHARE = 1 / 1024


def attach(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``facts`` (null where there are none), joined on equal columns ``on``.

    ``rows`` should be read from storage: they are read twice. The facts of crowded keys, fewer than 1024 rows whatever
    the data, are broadcast, so rows of those keys stay where they are; all others are shuffled.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total = rows.count()
    crowded = counts.where(F.col("_rows") > max(1.0, total * SHARE)).drop("_rows")
    keys = rows.sparkSession.createDataFrame(crowded.collect(), crowded.schema)
    marked = rows.join(F.broadcast(keys.withColumn("_crowded", F.lit(True))), on, "left")
    near = F.broadcast(facts.join(F.broadcast(keys), on, "left_semi"))
    here = marked.where(F.col("_crowded")).join(near, on, "left")
    there = marked.where(F.col("_crowded").isNull()).join(facts, on, "left")
    return here.unionByName(there).drop("_crowded")
