"""Exact top-k search by inner product of integer vectors, in tiles.

Query vectors are packed into matrices. A wave of them, of at most ``WAVE_BYTES`` whatever the table's
size, is sent to every executor and multiplied with each batch of candidates where that batch is read; a
partial selection keeps the best ``k`` of a tile. A task merges what its tiles gave, and the tasks' lists
are merged in a tree whose nodes read ``FAN_IN`` lists. The candidates are scanned once a wave and never shuffled.

Defined cases: null vectors, vectors with null, NaN or infinite components, and rows of null id take no part;
vectors meet only vectors of their own length; a candidate with the query's id is the query's own; where
query rows repeat an id, one of them (the smallest vector) asks; candidate rows that repeat count each; ties go to the
smaller id. Scores are 64-bit integers. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows of a query matrix, and of a candidate matrix.
TILE = 1024
#: Bytes of query matrices sent to the executors at once.
WAVE_BYTES = 32 << 20
#: Lists that a node of the merge tree reads.
FAN_IN = 64
#: Up to this bound sums of products are exact in double arithmetic.
EXACT = float(1 << 53)


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component as bigint; null for a vector that takes no part."""
    doubles = vector.cast("array<double>")
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")))


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids in ascending order and their vectors, a pair for each vector length and tile."""
    for batch in batches:
        sizes = batch["v"].map(len)
        for _, same in batch.groupby(sizes):
            same = same.sort_values("id", kind="stable")
            for a in range(0, len(same), TILE):
                some = same.iloc[a : a + TILE]
                yield some["id"].to_numpy("int64"), np.stack([np.asarray(v, "int64") for v in some["v"]])


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < EXACT:
        return (q.astype("float64") @ c.astype("float64").T).astype("int64")
    return q @ c.T


def _best(ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of the ``k`` best allowed entries of each row; ids ascend along each row."""
    low = np.iinfo("int64").min
    scores = np.where(allowed, scores, low)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        allowed = allowed & (scores >= least[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(scores.shape[0]))
    keep = np.arange(len(row)) - first[row] < k
    row, column = row[keep], column[keep]
    return row, ids[column], scores[row, column]


def _search(candidates: DataFrame, wave, k: int) -> DataFrame:
    """The best of each task for each query of the wave."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, best = TaskContext.get().partitionId(), {}
        for ids, c in _matrices(batches):
            for t, (query_ids, q) in enumerate(wave.value):
                if q.shape[1] != c.shape[1]:
                    continue
                row, found, score = _best(ids, _products(q, c), query_ids[:, None] != ids[None, :], k)
                if t in best:
                    row, found, score = (np.concatenate(x) for x in zip(best[t], (row, found, score), strict=True))
                    order = np.lexsort((found, -score, row))
                    row, found, score = row[order], found[order], score[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, found, score = row[keep], found[keep], score[keep]
                best[t] = row, found, score
        for t, (row, found, score) in best.items():
            yield pd.DataFrame({"query_id": wave.value[t][0][row], "vec_id": found, "score": score, "part": part})

    return candidates.mapInPandas(run, "query_id bigint, vec_id bigint, score bigint, part bigint")


def top_k(candidates: DataFrame, queries: DataFrame, k: int, vector: str = "v", id_col: str = "vec_id") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` best candidates of each query.

    ``vector`` holds integers (see ``quantised``); ids are of type bigint.
    """
    spark = candidates.sparkSession
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull()) & F.col(id_col).isNotNull()
    rows = lambda df: df.where(sound).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<bigint>").alias("v"))
    asked = written(rows(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, width = asked.agg(F.count("id"), F.max(F.size("v"))).first()
    waves = max(1, -(-n * 8 * (1 + (width or 0)) // WAVE_BYTES))
    at = F.pmod(F.xxhash64("id"), F.lit(waves))
    lists = None
    for w in range(waves):
        taken = asked.where(at == w).toPandas()  # at most about WAVE_BYTES
        found = _search(rows(candidates), spark.sparkContext.broadcast(list(_matrices([taken]))), k)
        found = found if waves == 1 else written(found, "lists")
        lists = found if lists is None else lists.unionByName(found)
    parts = max(1, rows(candidates).rdd.getNumPartitions())
    while True:
        parts = -(-parts // FAN_IN)
        lists = lists.withColumn("part", F.expr(f"part div {FAN_IN}") if parts > 1 else F.lit(0).cast("bigint"))
        order = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if parts <= 1:
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        lists = lists.drop("rank")
