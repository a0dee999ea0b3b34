"""Keys that a table has seen, so that a unique rule holds over all batches of a stream.

Each batch leaves a digest of each unique column beside the table: the sorted 64-bit hashes of its keys. A new batch meets the
digests, not the table: only if a hash is there already are the keys themselves read, and only those of the months that the hash came in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerwright.operators.lineage import BATCH, BRONZE_PARTITION
from layerwright.operators.lookup import broadcast_limit
from layerwright.operators.quality import Outcome
from layerwright.sources.workspace import Staged, file_system, remove
from layerwright.spec import Rule

DIGESTS = "_seen"
#: Bytes that a hash takes in a broadcast table.
HASHED = 64


def _digests(target: str, column: str) -> str:
    return f"{target}/{DIGESTS}/{column}"


def _hashed(df: DataFrame, column: str) -> DataFrame:
    """The batch's known keys as hashes of their text; NULL is no key that could come again."""
    return df.where(F.col(column).isNotNull()).select(F.xxhash64(F.col(column).cast("string")).alias("h"))


def remember(staged: Staged, target: str, columns: list[str], batch: str, month: tuple[int, int]) -> None:
    """Leave the digests of a batch, in place of those of an earlier attempt."""
    for column in columns:
        hashes = _hashed(staged.df, column).distinct().sortWithinPartitions("h")
        placed = hashes.withColumns({c: F.lit(int(v)) for c, v in zip(BRONZE_PARTITION, month)})
        placed.write.mode("overwrite").parquet(f"{_digests(target, column)}/{BATCH}={batch}")


def forget(spark: SparkSession, target: str, columns: list[str], batch: str) -> None:
    for column in columns:
        remove(spark, f"{_digests(target, column)}/{BATCH}={batch}")


def seen_before(staged: Staged, target: str, column: str, batch: str) -> int:
    """How many rows of a batch have a key that an earlier batch has brought."""
    spark = staged.df.sparkSession
    root = _digests(target, column)
    place, files = file_system(spark, root)
    if not files.exists(place) or not files.listStatus(place):
        return 0
    known = spark.read.parquet(root).where(F.col(BATCH) != batch)
    mine = _hashed(staged.df, column).distinct()
    small = staged.rows * HASHED <= broadcast_limit(spark)
    met = known.join(F.broadcast(mine) if small else mine, "h", "left_semi")
    months = met.select(*BRONZE_PARTITION).distinct().collect()
    if not months:
        return 0
    # Equal hashes need not be equal keys: only now are keys read, a column of the months concerned.
    of_months: Column = reduce(Column.__or__, (reduce(Column.__and__, (F.col(c) == m[c] for c in BRONZE_PARTITION)) for m in months))
    keys = spark.read.parquet(target).where(of_months & (F.col(BATCH) != batch)).select(F.col(column).cast("string").alias("key"))
    hit = staged.df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("key")).withColumn("h", F.xxhash64("key"))
    hit = hit.join(met.select("h").distinct(), "h", "left_semi")
    return hit.join(keys.distinct(), "key", "left_semi").count()


def outcomes(staged: Staged, target: str, rules: list[Rule], batch: str) -> list[Outcome]:
    """What the unique rules measure over all batches: rows whose key came before."""
    return [Outcome(r, seen_before(staged, target, r.column, batch)) for r in rules]
