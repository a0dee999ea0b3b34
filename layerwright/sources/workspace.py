"""Tables written to the shared folder to cut lineage: a lost executor never re-runs what led to them."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

CHECKPOINT_DIR = "spark.checkpoint.dir"
_CURRENT: ContextVar[str | None] = ContextVar("current", default=None)
#: Folders of a cluster's own file system that turned out to be shared; they hold the application's id.
_SHARED: set[str] = set()
_TRYING = Lock()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor reaches: ``spark.checkpoint.dir``.

    On a cluster it must be named. A path of the machines' own file system may be mounted on all of them, or they may be one machine;
    so it is tried, once for an application, and refused if the driver and the executors do not see each other's files there. A local session
    that names none gets one of its own, the same for all its threads; the session's settings stay as they are.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    cluster = not spark.sparkContext.master.startswith("local")
    if cluster and not folder:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    path = f"{(folder or os.path.join(tempfile.gettempdir(), 'layerwright')).rstrip('/')}/layerwright/{app}"
    if cluster and (folder.startswith("file:") or (folder.startswith("/") and _default_is_local(spark))):
        with _TRYING:
            if path not in _SHARED:
                _try_out(spark, folder, path)
                _SHARED.add(path)
    return path


def _try_out(spark: SparkSession, folder: str, path: str) -> None:
    """Raise unless the driver and the executors see what each of them wrote below ``path``.

    Two short tasks for each core write a row each. What an executor writes for itself alone is not there when the driver gathers the
    tasks' files, and the rows are read by as many tasks again. Executors that come later are not tried.
    """
    refusal = f"{CHECKPOINT_DIR} is {folder}, which each machine has for itself"
    trial = f"{path}/trial-{uuid.uuid4().hex}"
    try:
        n = 2 * spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).write.parquet(trial)
        seen = spark.read.schema("id bigint").parquet(trial).agg(F.count("id"), F.sum("id")).first()
        remove(spark, trial)
    except Exception as failure:
        raise RuntimeError(f"{refusal}, or which cannot be written") from failure
    if tuple(seen) != (n, n * (n - 1) // 2):
        raise RuntimeError(f"{refusal}: of {n} rows written there, {seen[0]} are seen")


def _default_is_local(spark: SparkSession) -> bool:
    """Whether a path without a scheme is one of the machine's own."""
    return spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_CURRENT.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The path as its file system's object, and the file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    place, files = file_system(spark, path)
    files.delete(place, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """What is staged inside goes to a folder that is removed at the end, however it ends."""
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    before = _CURRENT.set(path)
    try:
        yield path
    finally:
        _CURRENT.reset(before)
        remove(spark, path)


@dataclass(frozen=True)
class Staged:
    """A written table, with its row count, its size as a hash table and the metrics asked for."""

    df: DataFrame
    rows: int
    hashed_bytes: int
    metrics: dict = field(default_factory=dict)


def size_columns(df: DataFrame) -> tuple[Column, Column]:
    """Aggregates giving the row count and the bytes the rows take in a broadcast hash table.

    A row costs a fixed part, eight bytes a column, and the length of its text.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    per_row = 48 + 8 * len(df.columns)
    text = sum((F.coalesce(F.octet_length(c).cast("bigint"), F.lit(0)) for c in texts), F.lit(0))
    rows = F.count(F.lit(1))
    return rows, (rows * per_row + F.coalesce(F.sum(text), F.lit(0))).cast("bigint")


def stage(df: DataFrame, name: str, metrics: dict[str, Column] | None = None) -> Staged:
    """Write ``df`` once and read it back, measuring it in the same pass.

    The metrics sit above the last shuffle, in the stage that writes, so a retried task or a
    re-run map stage does not count twice.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    rows, size = size_columns(df)
    seen = Observation()
    extra = [c.alias(k) for k, c in (metrics or {}).items()]
    df.observe(seen, rows.alias("_rows"), size.alias("_bytes"), *extra).write.parquet(path)
    found = dict(seen.get)
    return Staged(
        spark.read.schema(df.schema).parquet(path), found.pop("_rows"), found.pop("_bytes"), found
    )
