"""Joins of many rows to a table that describes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from layerwright.sources.workspace import Staged, size_columns, stage

MAX_BROADCAST = "spark.layerwright.maxBroadcastBytes"
DEFAULT_MAX_BROADCAST = 64 * 1024 * 1024
ROWS = "_rows_of_key"
FINE = 16


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_BROADCAST, str(DEFAULT_MAX_BROADCAST)))


def measure(*tables: DataFrame) -> list[int]:
    """Bytes each table would take in a broadcast hash table, all counted in one job."""
    sizes = [
        t.agg(size_columns(t)[1].alias("bytes")).select(F.lit(i).alias("i"), "bytes")
        for i, t in enumerate(tables)
    ]
    found = {r["i"]: r["bytes"] for r in reduce(DataFrame.unionAll, sizes).collect()}
    return [found[i] for i in range(len(tables))]


def matches(on: tuple[str, ...], prefix: str, null_safe: bool) -> Column:
    """Equality of the left side's key columns and the right side's prefixed ones."""
    equal = Column.eqNullSafe if null_safe else Column.__eq__
    return reduce(Column.__and__, (equal(F.col(k), F.col(prefix + k)) for k in on))


def prefixed(df: DataFrame, on: tuple[str, ...], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: prefix + k for k in on})


def with_known_keys(df: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """The rows that an equality can match."""
    return df.where(reduce(Column.__and__, (F.col(k).isNotNull() for k in on)))


def count_rows_per_key(rows: DataFrame, on: tuple[str, ...]) -> Staged:
    return stage_row_counts(rows.groupBy(*on).agg(F.count(F.lit(1)).alias(ROWS)), "key-counts")


def stage_row_counts(per_key: DataFrame, name: str) -> Staged:
    """Stage a table with one row per key and the key's row count, adding up the counts."""
    return stage(per_key, name, {ROWS: F.coalesce(F.sum(ROWS), F.lit(0))})


def _crowded_keys(counts: Staged, on: tuple[str, ...]) -> DataFrame:
    """Keys with more rows than an even shuffle partition holds, and how many pieces to cut each into.

    With P shuffle partitions there are fewer than P such keys and at most ``FINE`` * 2P pieces,
    whatever the data: a bound that makes them safe to broadcast. Pieces are smaller than an even
    partition, as several may meet in one.
    """
    parts = int(counts.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = max(1.0, counts.metrics[ROWS] / parts)
    crowded = counts.df.where(F.col(ROWS) > even)
    return crowded.select(*on, F.ceil(F.col(ROWS) * FINE / even).cast("int").alias("_pieces"))


def _position() -> Column:
    """Place of a row in its task. Tasks number their rows from 0 above the 33rd bit."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + F.spark_partition_id()


def _dealt_join(
    rows: DataFrame, table: DataFrame, crowded: DataFrame, on: tuple[str, ...], how: str, null_safe: bool
) -> DataFrame:
    """Shuffle join of rows of crowded keys, dealt out over several pieces, each of which meets its own copy of the key's table rows.

    The rows are sorted inside each task, by all their columns, and dealt out in that
    order: a task spreads its rows however few tasks there are, copies as well as others, and a
    retried task, whatever order its rows come in, deals them as before. NULL keys are dealt out too.
    """
    same_as_crowded = matches(on, "_c_", null_safe=True)
    helpers = [f"_c_{k}" for k in on] + ["_pieces"]
    sortable = [F.col(f.name) for f in rows.schema.fields if not isinstance(f.dataType, MapType)]
    dealt = (
        rows.join(crowded, same_as_crowded)
        .sortWithinPartitions(F.struct(*sortable))
        .withColumn("_piece", F.pmod(_position(), "_pieces"))
        .drop(*helpers)
    )
    copied = (
        table.join(crowded, same_as_crowded)
        .withColumn("_t__piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
        .drop(*helpers)
    )
    match = matches(on, "_t_", null_safe) & (F.col("_piece") == F.col("_t__piece"))
    return dealt.join(prefixed(copied, on, "_t_"), match, how).drop("_piece", "_t__piece")


def split_join(
    rows: DataFrame, table: DataFrame, on: tuple[str, ...], how: str, null_safe: bool, counts: Staged
) -> DataFrame:
    """Shuffle join that sets the rows of crowded keys apart. ``counts`` holds the rows of each key.

    Rows of all other keys go through a plain join. Rows of crowded keys, of which there are few, stay where they are
    if the table's rows of those keys fit the broadcast bound, and are dealt out over pieces if not.
    """
    keys = _crowded_keys(counts, on)
    drop = [f"_t_{k}" for k in on]
    right = prefixed(table, on, "_t_")
    if keys.isEmpty():
        return rows.join(right, matches(on, "_t_", null_safe), how).drop(*drop)
    crowded, same = F.broadcast(prefixed(keys, on, "_c_")), matches(on, "_c_", null_safe=True)
    others = rows.join(crowded, same, "left_anti").join(right, matches(on, "_t_", null_safe), how)
    near = table.join(crowded, same, "left_semi")
    if measure(near)[0] <= broadcast_limit(rows.sparkSession):
        here = rows.join(crowded, same, "left_semi")
        met = here.join(F.broadcast(prefixed(near, on, "_t_")), matches(on, "_t_", null_safe), how)
    else:
        met = _dealt_join(rows, table, crowded, on, how, null_safe)
    return others.drop(*drop).unionByName(met.drop(*drop))


def lookup_join(
    rows: DataFrame,
    table: DataFrame | Staged,
    on: str | tuple[str, ...],
    how: str = "left",
    null_safe: bool = False,
    table_bytes: int | None = None,
    row_counts: Staged | None = None,
) -> DataFrame:
    """Join ``rows`` (many, perhaps skewed) to ``table`` on equal keys; ``how`` is left or inner.

    The table is broadcast only if its measured size is within the bound set by
    ``spark.layerwright.maxBroadcastBytes``: then no row of ``rows`` moves. Beyond it, both sides
    are shuffled, crowded keys are cut into pieces, and the result is staged, so that it is
    shuffled once however often it is read. The rows are the same either way. ``row_counts`` (from
    ``stage_row_counts``) spares the pass that finds crowded keys.
    """
    on = (on,) if isinstance(on, str) else tuple(on)
    if isinstance(table, Staged):
        table, table_bytes = table.df, table.hashed_bytes
    if not null_safe:
        table = with_known_keys(table, on)
        rows = with_known_keys(rows, on) if how == "inner" else rows
    if table_bytes is None:
        (table_bytes,) = measure(table)
    if table_bytes > broadcast_limit(rows.sparkSession):
        counts = row_counts or count_rows_per_key(rows, on)
        return stage(split_join(rows, table, on, how, null_safe, counts), "looked-up").df
    small = F.broadcast(prefixed(table, on, "_t_"))
    return rows.join(small, matches(on, "_t_", null_safe), how).drop(*(f"_t_{k}" for k in on))


def lookup_all(rows: DataFrame, lookups: list[tuple[DataFrame, tuple[str, ...]]], how: str = "left") -> DataFrame:
    """``rows`` joined to one table after the other, each with its key columns; a key may come from a table before.

    All tables are measured in one job. If all fit the broadcast bound, no row moves. If not, the tables are first
    joined to the distinct keys that ``rows`` have, a narrow table, and ``rows`` meet the result in one join, however many tables
    there are. The counts of those keys tell which are crowded.
    """
    sizes = measure(*(table for table, _ in lookups))
    if max(sizes) <= broadcast_limit(rows.sparkSession):
        for (table, on), size in zip(lookups, sizes):
            rows = lookup_join(rows, table, on, how, table_bytes=size)
        return rows
    keys = tuple(dict.fromkeys(k for _, on in lookups for k in on if k in rows.columns))
    counts = count_rows_per_key(rows, keys)
    found = counts.df.drop(ROWS)
    for (table, on), size in zip(lookups, sizes):
        found = lookup_join(found, table, on, how, table_bytes=size)
    return lookup_join(rows, stage(found, "found"), keys, how, null_safe=True, row_counts=counts)
