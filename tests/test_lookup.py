"""Lookups by broadcast and by shuffle must agree with a plain nested loop."""

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from layerwright.operators import lookup_all, lookup_join, measure, with_group_mean
from layerwright.operators.lookup import count_rows_per_key, split_join
from layerwright.sources import stage


def skewed(spark, n=3000):
    """A third of the rows are copies under key 1, a tenth have no key, the rest spread out."""
    return spark.range(0, n, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(1))
        .when(F.col("id") % 10 == 1, F.lit(None).cast("int"))
        .otherwise((F.col("id") % 97).cast("int"))
        .alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("v"),
    )


def described(spark):
    """Names of keys 0..59; key 5 has two, and one row has no key."""
    pairs = [(k, f"n{k}") for k in range(60)] + [(5, "again"), (None, "nobody")]
    return spark.createDataFrame(pairs, "k int, name string")


def nested_loop(left, right, how, null_safe):
    right = [tuple(r) for r in right.collect()]
    out = []
    for k, v in (tuple(r) for r in left.collect()):
        hits = [name for rk, name in right if rk == k and (k is not None or null_safe)]
        out += [(k, v, name) for name in hits] or ([(k, v, None)] if how == "left" else [])
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_broadcast_path(spark, how, null_safe):
    left, right = skewed(spark), described(spark)
    joined = lookup_join(left, right, "k", how, null_safe)
    assert rows(joined) == nested_loop(left, right, how, null_safe)
    assert "BroadcastHashJoin" in plan(joined) and "SortMergeJoin" not in plan(joined)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_shuffle_path(spark, no_broadcast, how, null_safe):
    left, right = skewed(spark), described(spark)
    joined = lookup_join(left, right, "k", how, null_safe)
    assert rows(joined) == nested_loop(left, right, how, null_safe)
    assert "Join" not in plan(joined)  # staged: read as often as needed, shuffled once
    lazy = split_join(left, right, ("k",), how, null_safe, count_rows_per_key(left, ("k",)))
    assert "SortMergeJoin" in plan(lazy)


def sorts(df):
    """What is sorted in a plan, of each side of a join and of rows that are dealt out."""
    return [line.split("Sort [")[1] for line in plan(df).split("\n") if "Sort [" in line]


@pytest.mark.parametrize("near", ["broadcast", "dealt"])
def test_only_crowded_rows_are_dealt(spark, no_broadcast, near):
    """Rows of other keys are sorted by the join alone; rows of crowded keys do not move if the table's part is small."""
    left, right = skewed(spark), described(spark)
    counts = count_rows_per_key(left, ("k",))
    if near == "broadcast":
        spark.conf.set("spark.layerwright.maxBroadcastBytes", "1000")
    joined = split_join(left, right, ("k",), "left", False, counts)
    by_value = [s for s in sorts(joined) if "struct" in s]
    assert len(by_value) == (near == "dealt") and "LeftAnti" in plan(joined)
    assert len(sorts(joined)) == (5 if near == "dealt" else 2)
    assert rows(joined) == nested_loop(left, right, "left", False)


def test_even_keys_are_not_split(spark, no_broadcast):
    left = spark.range(4000).select((F.col("id") % 1000).cast("int").alias("k"), F.col("id").alias("v"))
    joined = split_join(left, described(spark), ("k",), "left", False, count_rows_per_key(left, ("k",)))
    assert plan(joined).count("SortMergeJoin") == 1 and "Anti" not in plan(joined)
    assert rows(joined) == nested_loop(left, described(spark), "left", False)


def several(spark):
    places = spark.createDataFrame([(k, f"p{k}", f"s{k % 3}") for k in range(60)] + [(5, "again", "s0")], "k int, place string, state string")
    towns = spark.createDataFrame([(k, y, k * y) for k in range(50) for y in (1, 2)], "k int, y int, town int")
    states = spark.createDataFrame([(f"s{i}", y, i + (y or 9)) for i in range(2) for y in (1, None)], "state string, y int, mean int")
    return [(places, ("k",)), (towns, ("k", "y")), (states, ("state", "y"))]


def test_lookups_after_each_other_in_one_shuffle(spark, no_broadcast):
    left = skewed(spark).withColumn("y", F.when(F.col("v") % 7 != 0, (F.col("v") % 3).cast("int")))
    found = lookup_all(left, several(spark))
    want = left
    for table, on in several(spark):
        want = want.join(table, list(on), "left")
    assert found.columns == ["k", "v", "y", "place", "state", "town", "mean"]
    assert rows(found) == rows(want.select(*found.columns))
    spark.conf.unset("spark.layerwright.maxBroadcastBytes")
    assert rows(lookup_all(left, several(spark))) == rows(found)
    assert plan(lookup_all(left, several(spark))).count("BroadcastHashJoin") == 3


SHARES = {
    "mixed": lambda id: id % 3 == 0,
    "clustered": lambda id: id < 10000,  # all of the key's rows in a few tasks
}


@pytest.mark.parametrize("copies", [True, False])
@pytest.mark.parametrize("share", SHARES)
@pytest.mark.parametrize("tasks", [1, 2, 6])
def test_crowded_key_is_cut_into_pieces(spark, no_broadcast, tasks, share, copies):
    """However the rows of a crowded key lie in the input tasks, the fullest shuffle partition of the
    join holds at most twice an even share."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hot = SHARES[share](F.col("id"))
        value = F.when(hot, F.lit(0)).otherwise(F.col("id")) if copies else F.col("id")
        key = F.when(hot, F.lit(1)).otherwise((F.col("id") % 97).cast("int"))
        left = spark.range(0, 30000, 1, tasks).select(key.alias("k"), value.alias("v"))
        counts = count_rows_per_key(left, ("k",))
        joined = split_join(left, described(spark), ("k",), "left", False, counts)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        found = joined.groupBy("k", "name").count()
        want = left.join(described(spark), "k", "left").groupBy("k", "name").count()
        assert rows(found) == rows(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) <= 2 * sum(sizes) / 16


def test_a_task_that_runs_again_deals_alike(spark):
    """The piece of a row does not depend on the order in which a task gets its rows."""
    from layerwright.operators.lookup import _position

    data = [(i % 7, i % 3) for i in range(500)]
    dealt = []
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "k int, v int").coalesce(1).sortWithinPartitions("k", "v")
        dealt.append(rows(df.withColumn("piece", F.pmod(_position(), F.lit(5)))))
    assert dealt[0] == dealt[1]


def test_two_keys_and_staged_table(spark):
    left = spark.createDataFrame([(1, "a", 9), (1, None, 8), (2, "a", 7)], "x int, y string, z int")
    right = stage(spark.createDataFrame([(1, "a", 0.5)], "x int, y string, w double"), "t")
    assert right.rows == 1
    found = lookup_join(left, right, ("x", "y"))
    assert found.columns == ["x", "y", "z", "w"]
    assert rows(found) == [(1, "a", 9, 0.5), (1, None, 8, None), (2, "a", 7, None)]


@pytest.mark.parametrize("path", ["broadcast", "shuffle"])
def test_nan_is_a_key(spark, path, request):
    if path == "shuffle":
        request.getfixturevalue("no_broadcast")
    nan = float("nan")
    left = spark.createDataFrame([(nan, 1), (2.0, 2), (None, 3)], "k double, v int")
    right = spark.createDataFrame([(nan, "n"), (None, "x")], "k double, name string")
    found = {r["v"]: r["name"] for r in lookup_join(left, right, "k").collect()}
    assert found == {1: "n", 2: None, 3: None}


def test_measure_counts_text(spark):
    short = spark.createDataFrame([("a",), (None,)], "t string")
    long = spark.createDataFrame([("a" * 1000,), (None,)], "t string")
    a, b = measure(short, long)
    assert b - a == 999
    assert measure(short.where("false")) == [0]


def expected_means(df):
    groups = {}
    data = [tuple(r) for r in df.collect()]
    for k, v in data:
        groups.setdefault(k, []).append(v)
    return sorted(((k, v, round(sum(groups[k]) / len(groups[k]), 2)) for k, v in data), key=repr)


def integers(spark):
    return skewed(spark).select("k", (F.col("v") * 8).cast("double").alias("v"))


def test_group_mean(spark):
    df = integers(spark)
    found = with_group_mean(df, ("k",), "v", "mean")
    assert [r[:2] for r in rows(found)] == [r[:2] for r in expected_means(df)]
    assert all(abs(a[2] - b[2]) <= 0.01 for a, b in zip(rows(found), expected_means(df)))
    assert "Window" not in plan(found)


def test_group_mean_by_shuffle_is_the_same(spark, no_broadcast):
    df = integers(spark)
    found = with_group_mean(df, ("k",), "v", "mean")
    spark.conf.unset("spark.layerwright.maxBroadcastBytes")
    assert rows(found) == rows(with_group_mean(df, ("k",), "v", "mean"))
