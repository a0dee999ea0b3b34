"""Questions from batches of documents to blocks of a distributed index, and the answers back.

Documents are dealt to batches by a hash, and 64-bit keys to blocks. A batch sends a block its distinct keys as one
packed row, each with a mark if it occurs more than once in the batch; the block says which
of them occur more than once at all. However often a key occurs, a batch names it once, so no key weighs more
than the number of batches, and a block holds an even share of the distinct keys. Batches and blocks have a
set size; their number grows with the input.

Everything here is a function of the rows' content, so a task that runs again sends the same.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes in a batch of documents, and text bytes whose keys share a block.
BATCH_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20
ASKED = "block int, batch int, keys binary, many binary, places binary"
ANSWERED = "batch int, block int, stage int, hits binary, sources binary"


def dealt(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int, int]:
    """``docs`` as ``batch``, ``ord`` (a hash of the row), ``raw`` (the text's bytes) and ``row`` (all other columns); the numbers of batches and blocks."""
    content = F.col(text).cast("string")
    total = docs.agg(F.sum(F.octet_length(content).cast("bigint"))).first()[0] or 0
    batches, blocks = max(1, -(-total // BATCH_BYTES)), max(1, -(-total // BLOCK_BYTES))
    place = F.xxhash64(F.col(id_col), content)
    dealt = docs.select(
        F.pmod(place, F.lit(batches)).cast("int").alias("batch"),
        place.alias("ord"),
        content.cast("binary").alias("raw"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
    )
    return dealt, batches, blocks


def in_order(docs: pa.Table) -> pa.Table:
    """The documents of a batch in an order that any task finds again."""
    order = docs.column("ord").to_numpy()
    size = pa.compute.fill_null(pa.compute.binary_length(docs.column("raw")), -1).to_numpy()
    return docs.take(pa.array(np.lexsort((size, order))))


def raw_texts(docs: pa.Table) -> list[bytes | None]:
    return docs.column("raw").to_pylist()


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(24)) % np.uint64(blocks)).astype("int64")


def by_block(keys: np.ndarray, blocks: int) -> list[tuple[int, np.ndarray]]:
    """For each block that gets any: its number and where its keys are, in ascending order of places."""
    block = block_of(keys, blocks)
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
    return [(int(block[p[0]]), p) for p in np.split(order, cuts[1:])] if len(order) else []


def asked(batch: int, keys: np.ndarray, many: np.ndarray, places: np.ndarray | None, blocks: int) -> pa.Table:
    """Rows that ask about sorted distinct ``keys``; ``many`` marks keys found more than once in the batch."""
    parts = by_block(keys, blocks)
    return pa.table(
        {
            "block": pa.array([b for b, _ in parts], pa.int32()),
            "batch": pa.array([batch] * len(parts), pa.int32()),
            "keys": pa.array([keys[p].astype("<u8").tobytes() for _, p in parts], pa.binary()),
            "many": pa.array([np.packbits(many[p]).tobytes() for _, p in parts], pa.binary()),
            "places": pa.array([None if places is None else places[p].astype("<u4").tobytes() for _, p in parts], pa.binary()),
        }
    )


def answers(questions: DataFrame, stage: int) -> DataFrame:
    """For each question, which of its keys occur twice or more among all (their numbers in its list).

    Where places are given, ``sources`` holds for each hit the address of another occurrence, the first one in the order
    of batches if that is not the asker's, else the second: ``batch << 32 | place``; its own where there is no other batch.
    """

    def run(block: pa.Table) -> pa.Table:
        block = block.take(pa.array(np.argsort(block.column("batch").to_numpy(), kind="stable")))
        lists = [np.frombuffer(k, "<u8") for k in block.column("keys").to_pylist()]
        sizes = np.array([len(k) for k in lists])
        keys = np.concatenate(lists)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, "uint8"), count=n) for m, n in zip(block.column("many").to_pylist(), sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        fresh = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] ^ np.uint64(1)))
        group = np.zeros(len(keys), "int64")
        group[order] = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(keys))))
        times = np.bincount(group) + np.bincount(group, weights=many).astype("int64")
        hit = times[group] > 1
        batches = block.column("batch").to_numpy()
        addresses = None
        if block.column("places").null_count == 0:
            place = np.concatenate([np.frombuffer(p, "<u4") for p in block.column("places").to_pylist()])
            address = (np.repeat(batches, sizes).astype("uint64") << np.uint64(32)) | place
            first = order[fresh]
            second = order[np.minimum(fresh + 1, len(order) - 1)]
            second = np.where(keys[second] == keys[first], second, first)
            other = np.where(first[group] == np.arange(len(keys)), second[group], first[group])
            addresses = address[other]
        out, at = [], 0
        for n in sizes:
            hits = np.flatnonzero(hit[at : at + n])
            out.append((hits.astype("<u4").tobytes(), None if addresses is None else addresses[at + hits].astype("<u8").tobytes()))
            at += n
        keep = [i for i, (h, _) in enumerate(out) if h]
        return pa.table(
            {
                "batch": pa.array(batches[keep], pa.int32()),
                "block": block.column("block").take(pa.array(keep, pa.int64())),
                "stage": pa.array([stage] * len(keep), pa.int32()),
                "hits": pa.array([out[i][0] for i in keep], pa.binary()),
                "sources": pa.array([out[i][1] for i in keep], pa.binary()),
            }
        )

    return questions.groupBy("block").applyInArrow(run, ANSWERED)


def hits_of(keys: np.ndarray, blocks: int, replies: Iterable[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Marks the asked ``keys`` that the replies hit; their sources (0 where none were asked for)."""
    hit, source = np.zeros(len(keys), bool), np.zeros(len(keys), "uint64")
    places = dict(by_block(keys, blocks))
    for r in replies:
        at = places[r["block"]][np.frombuffer(r["hits"], "<u4")]
        hit[at] = True
        if r["sources"] is not None:
            source[at] = np.frombuffer(r["sources"], "<u8")
    return hit, source
