"""Connected components of links, by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component``, the smallest node that the undirected links reach, for each node of a link.

    A round points every node at its smallest neighbour and that neighbour's other nodes with it, so the number of rounds
    grows with the logarithm of the longest chain. A node of many links is summed up before the shuffle, and its links are
    joined to one row, which adaptive execution splits. Links with a null end and links of a node to itself count for nothing.
    """
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = written(links, "links")
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("low"))
        large = both.where("v > u").join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        large = written(large.distinct(), "stars")
        least = large.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("low"))
        small = large.join(least, F.col("u") == F.col("at")).where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.unionByName(least.select(F.col("at").alias("u"), F.col("low").alias("v")))
        links = written(small.distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
