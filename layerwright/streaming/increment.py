"""Bronze from files that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from layerwright.operators.lineage import BATCH, BRONZE_PARTITION, SOURCE_FILE, RunStamp, add_lineage, row_digest
from layerwright.operators.quality import counters, evaluate, gate
from layerwright.sources.landing import CSV_OPTIONS, RAGGED, WHOLE_LINES, landing_schema, ragged_schema, set_ragged_apart, typed
from layerwright.sources.layers import MissingPartition, write_partitioned
from layerwright.sources.workspace import file_system, stage, staging
from layerwright.spec import Entity, Rule
from layerwright.streaming import ledger, seen

COMPACTED = "compacted"
ROW_DIGEST = "_row_digest"


def batch_name(batch_id: int) -> str:
    return f"stream-{batch_id}"


def _forget(spark: SparkSession, root: str, batch: str) -> None:
    """Remove what an earlier attempt at a batch wrote, in whatever month."""
    pattern = "/".join([root, *("*" for _ in BRONZE_PARTITION), f"{BATCH}={batch}"])
    place, files = file_system(spark, pattern)
    for found in files.globStatus(place) or ():
        files.delete(found.getPath(), True)


def land_increment(
    entity: Entity,
    target: str,
    clock: Callable[[], RunStamp],
    null_safe_hash: bool = True,
    unparsed: str = "fail",
    ragged: str = "fail",
    unique_over: str = "table",
    copies: str = "refuse",
):
    """The work on one micro-batch of text rows: lineage, types, rules, then the write.

    A failed rule raises before the write, so the batch is not committed and comes again. Each
    batch owns a partition below the month, and a batch that comes again replaces it, so it adds no
    duplicates. Unique rules hold over all batches of the stream (see ``seen``), or with ``unique_over="batch"`` within each.
    A file with the rows of one that came before is refused whole, before the rules, and stands in the ledger (see ``ledger``);
    ``copies="take"`` keeps no ledger and takes it.
    """
    if copies not in ("refuse", "take"):
        raise ValueError(f"copies must be 'refuse' or 'take', not {copies!r}")
    if unique_over not in ("table", "batch"):
        raise ValueError(f"unique_over must be 'table' or 'batch', not {unique_over!r}")
    unique = [r for r in entity.rules if r.kind == "unique"] if unique_over == "table" else []
    columns = [r.column for r in unique]

    def land(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, batch_name(batch_id)
        stamp = clock()
        month = (int(stamp.year), int(stamp.month))
        lined = add_lineage(batch, entity.name, stamp, null_safe_hash)
        if copies == "refuse":  # the row hash may skip NULLs
            lined = lined.withColumn(ROW_DIGEST, F.col("_record_hash") if null_safe_hash else row_digest(batch.columns))
        bronze = typed(lined, entity.raw_types, unparsed=True).withColumn(BATCH, F.lit(name))
        strict = entity.parse_rules(batch.columns) if unparsed == "fail" else ()
        width = (Rule("width"),) if ragged == "fail" and RAGGED in batch.columns else ()
        rules = (*entity.rules, *strict, *width)
        with staging(spark):
            put_aside = lambda df: stage(df, f"{entity.name}-increment", counters(df, rules))
            staged, files = put_aside(bronze), None
            if copies == "refuse":
                files = ledger.arrivals(staged, target, ROW_DIGEST, name)
                if files.metrics["copies"]:
                    staged = put_aside(ledger.without_copies(staged, files))
            _forget(spark, target, name)
            if staged.rows or not (files and files.metrics["copies"]):
                gate(evaluate({entity.name: (staged, rules)}))
                gate({entity.name: seen.outcomes(staged, target, unique, name)})
                write_partitioned(staged.df.drop(ROW_DIGEST), target, (*BRONZE_PARTITION, BATCH), keep_others=True)
                seen.remember(staged, target, columns, name, month)
            if files:
                ledger.record(files, target, name)

    return land


def ingest_new_files(
    spark: SparkSession,
    landing: str,
    target: str,
    progress: str,
    entity: Entity,
    clock: Callable[[], RunStamp] = RunStamp.now,
    max_files: int | None = None,
    null_safe_hash: bool = True,
    unparsed: str = "fail",
    ragged: str = "fail",
    multiline: bool = False,
    unique_over: str = "table",
    copies: str = "refuse",
) -> StreamingQuery:
    """Take in the files of a landing folder that ``progress`` does not know yet, and stop.

    ``target`` is a bronze table as a bronze run writes it: both may write to the same one, which is
    read by month. ``progress`` must outlive the run and be reachable from the cluster. ``max_files``
    bounds a micro-batch. ``unparsed``, ``ragged`` and ``multiline`` are as in a bronze run, ``unique_over`` and ``copies`` as in ``land_increment``.
    """
    reader = spark.readStream.options(**CSV_OPTIONS, **WHOLE_LINES, enforceSchema=False, multiLine=multiline)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = reader.schema(ragged_schema(landing_schema(spark, landing, multiline))).csv(landing)
    raw = set_ragged_apart(text).select("*", F.col("_metadata.file_path").alias(SOURCE_FILE))
    return (
        raw.writeStream.foreachBatch(land_increment(entity, target, clock, null_safe_hash, unparsed, ragged, unique_over, copies))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def compact_month(spark: SparkSession, root: str, stamp: RunStamp) -> int:
    """Write the batches of a finished month anew as one, and return how many there were.

    The new files stand ready under a name that readers skip before the old ones go, so an attempt that
    breaks off is finished by the next one. Nothing else may write to the month meanwhile.
    """
    month = "/".join([root, *(f"{c}={v}" for c, v in zip(BRONZE_PARTITION, (stamp.year, stamp.month)))])
    ready = f"{month}/_{COMPACTED}"
    place, files = file_system(spark, ready)
    parent = place.getParent()
    if not files.exists(parent):
        raise MissingPartition(f"{root} has no rows for {stamp.year}-{stamp.month}")
    batches = [
        s.getPath() for s in files.listStatus(parent) if s.isDirectory() and s.getPath().getName().startswith(f"{BATCH}=")
    ]
    done = spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")
    if not files.exists(done):
        if len(batches) < 2:
            return len(batches)
        rows = spark.read.parquet(*(b.toString() for b in batches))
        rows.drop(BATCH).hint("rebalance").write.mode("overwrite").parquet(ready)
    for old in batches:
        files.delete(old, True)
    files.rename(place, spark._jvm.org.apache.hadoop.fs.Path(parent, f"{BATCH}={COMPACTED}"))
    return len(batches)
