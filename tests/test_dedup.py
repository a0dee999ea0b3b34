import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from layerwright.operators import dedup_by_key, find_repeats, first_per_key

KEY = ("a", "b")


def table(spark, parts=5):
    """Key (0, x) has a third of the rows, many of them copies; some keys are NULL."""
    df = spark.range(0, 900, 1, parts)
    return df.select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 211).cast("int").alias("a"),
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 7 == 0, None).otherwise("y").alias("b"),
        F.nullif(F.col("id") % 5, F.lit(3)).alias("payload"),
        (F.col("id") % 2 == 0).alias("flag"),
    )


def brute_force(df):
    best = {}
    for r in (tuple(r) for r in df.collect()):
        order = tuple((v is not None, v if v is not None else 0) for v in r[2:])
        if r[:2] not in best or order < best[r[:2]][0]:
            best[r[:2]] = (order, r)
    return sorted((r for _, r in best.values()), key=repr)


def test_both_ways_keep_the_same_first_rows(spark):
    df = table(spark)
    assert rows(first_per_key(df, KEY)) == brute_force(df)
    assert rows(dedup_by_key(df, KEY)) == brute_force(df)


def test_many_repeated_keys(spark, no_broadcast):
    df = table(spark)
    assert rows(dedup_by_key(df, KEY)) == brute_force(df)


def test_result_does_not_depend_on_partitions(spark):
    assert rows(dedup_by_key(table(spark, 1), KEY)) == rows(dedup_by_key(table(spark, 8).repartition(13), KEY))


def test_idempotent(spark):
    once = dedup_by_key(table(spark), KEY)
    assert rows(dedup_by_key(once, KEY)) == rows(once)


def test_table_without_repeats_is_left_alone(spark):
    df = spark.range(10).select(F.col("id").alias("a"), F.lit("z").alias("b"))
    assert dedup_by_key(df, KEY) is df


def test_counts(spark):
    df = table(spark)
    keys = len({tuple(r)[:2] for r in df.collect()})
    found = find_repeats(df, KEY)
    assert (found.total_rows, found.distinct_keys, found.duplicates) == (900, keys, 900 - keys)


@pytest.mark.parametrize("sql", ["false"])
def test_empty(spark, sql):
    empty = table(spark).where(sql)
    found = find_repeats(empty, KEY)
    assert (found.total_rows, found.distinct_keys, found.duplicates) == (0, 0, 0)


def test_copies_of_a_key_are_cut_down_before_the_shuffle(spark):
    text = plan(first_per_key(table(spark), KEY))
    before_shuffle = text[text.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle
