import random

import pytest
from pyspark.sql import functions as F

from layerwright.llm import topk


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])]
    return sorted(out)


def rows_of(seed, n, spread):
    rng = random.Random(seed)
    return [(i, [rng.randint(-spread, spread) for _ in range(4)]) for i in range(n)]


@pytest.mark.parametrize(("n", "spread"), [(150, 3), (40, 1 << 20), (3, 5), (60, 1 << 29)])
def test_like_brute_force_with_ties(spark, monkeypatch, n, spread):
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rows = rows_of(1, n, spread)
    frame = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>").repartition(5)
    found = topk.top_k(frame, frame.where("vec_id % 10 = 0"), 5)
    assert sorted(map(tuple, found.collect())) == brute(rows, [r for r in rows if r[0] % 10 == 0], 5)


def test_several_waves_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE_BYTES", 200)
    rows = rows_of(2, 120, 4)
    frame = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>").repartition(3)
    found = topk.top_k(frame, frame.where("vec_id % 10 = 0"), 3)
    assert sorted(map(tuple, found.collect())) == brute(rows, [r for r in rows if r[0] % 10 == 0], 3)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, -0.001]), (None, [1.0, 1.0]), (6, [1.0]), (5, [0.5, -0.001]), (50, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    found = topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 5, 256 * 128 - 512), (0, 2, 5, 256 * 128 - 512)]


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "vec_id bigint, v array<bigint>")
    assert topk.top_k(frame, frame, 5).count() == 0
