"""Files that a stream has taken in, so that a file delivered again under another name is refused.

Two files are the same delivery if they hold the same rows equally often, in whatever order: a file's digest is its row count and the
sums of four 60-bit pieces of its rows' SHA-256, which one aggregation takes from the staged rows, combined before the shuffle.
Beside the table, each batch leaves a row for each of its files, also for those refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerwright.functions import count_where
from layerwright.operators.lineage import BATCH, SOURCE_FILE
from layerwright.operators.lookup import broadcast_limit
from layerwright.sources.workspace import Staged, file_system, stage

LEDGER = "_files"
#: Columns of a ledger; ``same_as`` names the file taken in before, of a refused one.
SCHEMA = "file string, rows bigint, digest string, same_as string"
LANES, LANE_HEX = 4, 15


def _lane(row_digest: str, i: int) -> Column:
    """Sum of a piece of the rows' hexadecimal digests, exact."""
    piece = F.conv(F.substring(row_digest, 1 + i * LANE_HEX, LANE_HEX), 16, 10)
    return F.sum(piece.cast("decimal(20,0)"))


def _digests(rows: DataFrame, row_digest: str) -> DataFrame:
    count = F.count(F.lit(1))
    told = [F.lpad(c.cast("string"), 30, "0") for c in (count, *(_lane(row_digest, i) for i in range(LANES)))]
    per_file = rows.where(F.col(SOURCE_FILE).isNotNull()).groupBy(F.col(SOURCE_FILE).alias("file"))
    return per_file.agg(count.alias("rows"), F.concat_ws("-", *told).alias("digest"))


def _exists(spark: SparkSession, path: str) -> bool:
    place, files = file_system(spark, path)
    return files.exists(place) and bool(files.listStatus(place))


def read_ledger(spark: SparkSession, target: str) -> DataFrame:
    """The files that came for a table: name, rows, digest, the same file taken in before (NULL if it was taken in itself), and batch."""
    path = f"{target}/{LEDGER}"
    schema = f"{SCHEMA}, {BATCH} string"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def arrivals(staged: Staged, target: str, row_digest: str, batch: str) -> Staged:
    """The files of a batch with ``same_as``, judged by all other batches and by each other; ``copies`` among the metrics counts those refused.

    Of equal files in one batch the first by name is taken. A batch that comes again does not meet itself, and a file that is read again
    under its own name is no copy.
    """
    spark = staged.df.sparkSession
    files = stage(_digests(staged.df, row_digest), "files").df
    first = files.groupBy("digest").agg(F.min("file").alias("_first"))
    taken = read_ledger(spark, target).where((F.col(BATCH) != batch) & F.col("same_as").isNull())
    known = taken.groupBy("digest").agg(F.min("file").alias("_known"))
    judged = files.join(first, "digest").join(known, "digest", "left")
    before = F.coalesce("_known", "_first")
    same_as = F.when(F.col("file") != before, before)
    return stage(judged.select("file", "rows", "digest", same_as.alias("same_as")), "judged", {"copies": count_where(F.col("same_as").isNotNull())})


def without_copies(staged: Staged, files: Staged) -> DataFrame:
    """The staged rows of the files that are taken."""
    refused = files.df.where(F.col("same_as").isNotNull()).select(F.col("file").alias(SOURCE_FILE))
    small = files.hashed_bytes <= broadcast_limit(staged.df.sparkSession)
    return staged.df.join(F.broadcast(refused) if small else refused, SOURCE_FILE, "left_anti").select(*staged.df.columns)


def record(files: Staged, target: str, batch: str) -> None:
    """Leave a batch's files, in place of those of an earlier attempt."""
    files.df.write.mode("overwrite").parquet(f"{target}/{LEDGER}/{BATCH}={batch}")
