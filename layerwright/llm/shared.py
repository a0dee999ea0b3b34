"""What several operators need: intermediate tables in the shared folder, free column names, row identity."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerwright.sources.workspace import remove, shared_folder

_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder for a table of its own."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (noted := _NOTED.get()) is not None:
        noted.append(path)
    return path


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Adds the paths of all tables ``written`` inside to ``paths``."""
    before = _NOTED.set(paths)
    try:
        yield
    finally:
        _NOTED.reset(before)


def remove_unused(spark: SparkSession, paths: list[str], df: DataFrame) -> None:
    """Deletes the tables at ``paths`` that ``df`` does not read, through the paths' file system."""
    used = df.inputFiles()
    for path in [p for p in paths if not any(os.path.basename(p) in f for f in used)]:
        remove(spark, path)
        paths.remove(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, underscored until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def text_key(text: Column) -> Column:
    """A hash that tells apart texts under one id; null and the empty text count as one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: What a Python worker's memory manager is told: give large blocks back when they are freed, as workers wait for
#: further tasks beside the executor's own memory.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": "2097152", "MALLOC_TRIM_THRESHOLD_": "8388608", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
BATCH_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def workers_ready(spark: SparkSession) -> None:
    """Settings for Python workers, where the session leaves them open: they find this package where the driver found it,
    give memory back, and take batches of rows that stay small with long texts."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    for name, value in MEMORY.items():
        environment.setdefault(name, value)
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, ROWS)
