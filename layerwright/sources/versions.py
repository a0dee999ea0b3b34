"""Tables of a layer that change together.

A run writes its tables to a folder of its own, ``_runs/<run>`` of the layer. One empty file in ``_published`` then says that the run
counts; its name holds what it replaces, a number that grows, and the run. Creating an empty file either happens or does not, on any file
system. From then on readers take a table from the run's folder, until it has been moved to its place in the layer; so they see
all tables of the old run or all of the new one, also if the moving breaks off, which the next run carries on.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from layerwright.sources.workspace import file_system, remove

POINTERS, RUNS = "_published", "_runs"
_NAME = re.compile(r"(?P<scope>.+)\.(?P<number>\d{10})\.(?P<run>r[0-9a-f]{32})")


def _scope(values: dict[str, int]) -> str:
    """The name of what is replaced: a month, by its partition values, or whole tables."""
    return ",".join(f"{c}={int(v)}" for c, v in values.items()) or "all"


def _listed(spark: SparkSession, folder: str) -> list:
    place, files = file_system(spark, folder)
    return [s.getPath() for s in files.listStatus(place)] if files.exists(place) else []


def _exists(spark: SparkSession, path: str) -> bool:
    place, files = file_system(spark, path)
    return files.exists(place)


def _pointers(spark: SparkSession, layer: str) -> list[re.Match]:
    """Runs that count and have not been moved yet, in order."""
    found = [m for p in _listed(spark, f"{layer}/{POINTERS}") if (m := _NAME.fullmatch(p.getName()))]
    return sorted(found, key=lambda m: int(m["number"]))


def pending(spark: SparkSession, root: str, **values: int) -> str | None:
    """Where a table's rows are that count, if not yet in their place."""
    layer, _, table = root.rstrip("/").rpartition("/")
    for pointer in reversed(_pointers(spark, layer)):
        path = f"{layer}/{RUNS}/{pointer['run']}/{table}"
        if pointer["scope"] == _scope(values) and _exists(spark, path):
            return path
    return None


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """A table that is replaced as a whole."""
    return spark.read.parquet(pending(spark, root) or root)


@contextmanager
def run_folder(spark: SparkSession, layer: str) -> Iterator[str]:
    """A folder for a run's tables. What an earlier run left to be moved is moved first; what this run does not publish is removed."""
    finish(spark, layer)
    run = f"r{uuid.uuid4().hex}"
    try:
        yield f"{layer}/{RUNS}/{run}"
    finally:
        if not any(p["run"] == run for p in _pointers(spark, layer)):
            remove(spark, f"{layer}/{RUNS}/{run}")


def publish(spark: SparkSession, folder: str, **values: int) -> None:
    """Let the tables in a run's folder count from now on, all at once: in place of a month, or of whole tables."""
    layer, _, run = (part.rstrip("/") for part in folder.replace(f"/{RUNS}/", "\0").partition("\0"))
    number = max((int(p["number"]) for p in _pointers(spark, layer)), default=-1) + 1
    place, files = file_system(spark, f"{layer}/{POINTERS}/{_scope(values)}.{number:010}.{run}")
    files.create(place, False).close()
    finish(spark, layer)


def finish(spark: SparkSession, layer: str) -> None:
    """Move the tables of the runs that count to their places. Each step can be taken again."""
    for pointer in _pointers(spark, layer):
        folder = f"{layer}/{RUNS}/{pointer['run']}"
        depth = 0 if pointer["scope"] == "all" else pointer["scope"].count(",") + 1
        for table in _listed(spark, folder):
            _move(spark, folder, f"{layer}/{table.getName()}", table, depth)
        place, files = file_system(spark, f"{layer}/{POINTERS}/{pointer.string}")
        files.delete(place, False)
        remove(spark, folder)


def _move(spark: SparkSession, folder: str, to: str, table, depth: int) -> None:
    """Put the folders ``depth`` partition columns below a written table in place of those of the same name."""
    _, files = file_system(spark, folder)
    found = [(table, to)]
    for _ in range(depth):
        found = [(s.getPath(), f"{t}/{s.getPath().getName()}") for p, t in found for s in files.listStatus(p) if s.isDirectory()]
    for source, target in found:
        place, _ = file_system(spark, target)
        files.delete(place, True)
        files.mkdirs(place.getParent())
        if not files.rename(source, place):
            raise OSError(f"{source.toString()} cannot be moved to {target}")
    files.delete(table, True)
