"""A trie of conversations by their turns, from digests of blocks of several turns.

A conversation is cut into blocks of ``BLOCK`` turns. A block has a digest of its turns, and each block's end one of all turns so far (a
chain of digests). Conversations are grouped by these successive digests first, so however many share a beginning, they are one row a block.
Only where a prefix goes on in more than one block do its siblings' turn boundaries get digests of their own, and
blocks that begin alike share the nodes up to the turn where they part. A prefix that goes on in one block only has that
block's turns as a chain, without a further look.

Sums over subtrees need no walk. A node belongs to its smallest member, its owner; owners of a node own all nodes below it that they
are members of. So a node's saved tokens are the words in its members' turns that they do not own, from the node's depth on, and its leaves are its members
that own a childless node. Both are sums over groups of equal blocks. Steps: turns are reduced to digests and word counts where
they are read; one shuffle brings a conversation's turns into order; all that follows is aggregates and joins by digest, and
rows of crowded parents stay where they are (``hot.attach``).

Turns are ordered by ``turn`` (null first), then role, then the digest. ``with_beginnings`` gives conversations the first turns of others.

Defined cases: null roles and texts are empty; rows without a conversation id take no part; rows that repeat are turns of their
own; a conversation of any length is read in one sorted stream; texts of any length are digested where they are read; conversations without
turns are members of the root only; an empty table gives no rows, not even a root; other columns are not read. Digests are the first 16 bytes of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hot import attach
from .shared import written

#: Turns of a block, and bytes of a digest.
BLOCK, DIGEST = 4, 16
ROOT = b"\0" * DIGEST
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows that a streaming task sends at once, and conversation ids that are one piece of a list.
ROWS, IDS = 4096, 8192
BLOCKS = "conv_id bigint, block int, before binary, after binary, turns binary, words array<bigint>, words_before bigint, last boolean"


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``digest`` of role and text, and ``words`` of the text, without the text itself."""
    said, who = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)
    return conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        who.alias("role"),
        F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, DIGEST).alias("digest"),
        F.regexp_count(said, F.lit(WORDS)).cast("bigint").alias("words"),
    )


def with_beginnings(turns: DataFrame, of: Column, most: Column, limit: int) -> DataFrame:
    """``turns`` with those of a beginning: conversation ``of`` gives its first ``most`` turns (at most ``limit``), in place of as many of the conversation's own.

    Adds ``own`` (0 for a turn of the beginning) and ``skipped``, how many of its own turns a conversation leaves out.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "digest")
    ids = turns.select("conv_id").distinct().select("conv_id", of.alias("of"), most.cast("int").alias("most"))
    sources = ids.where(F.col("most") > 0).select(F.col("of").alias("conv_id")).distinct()
    heads = turns.join(sources, "conv_id", "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    heads = heads.withColumnsRenamed({"conv_id": "of"})
    begun = ids.where(F.col("most") > 0).join(heads, "of").where(F.col("place") <= F.col("most"))
    begun = begun.select("conv_id", F.lit(0).alias("own"), "place", F.lit(None).cast("bigint").alias("turn"), "role", "digest", "words", "most")
    own = turns.select("conv_id", F.lit(1).alias("own"), F.lit(0).alias("place"), "turn", "role", "digest", "words", most.cast("int").alias("most"))
    return begun.unionByName(own).withColumnRenamed("most", "skipped")


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of conversations whose turns come in order; a conversation without turns has one empty block."""
    out: list[tuple] = []
    conv, state = None, None

    def close(last: bool) -> None:
        digests, words, block, before, so_far = state
        turns = b"".join(digests)
        after = hashlib.sha256(before + turns).digest()[:DIGEST] if digests else before
        out.append((conv, block, before, after, turns, words, so_far, last))
        state[:] = [[], [], block + 1, after, so_far + sum(words)]

    def sent() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.bool_())
        names = ["conv_id", "block", "before", "after", "turns", "words", "words_before", "last"]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return batch

    skip = 0
    for rows_ in rows:
        columns = [rows_.column(i).to_pylist() for i in range(rows_.num_columns)]
        for c, own, digest, words, skipped in zip(*columns, strict=True):
            if c != conv:
                if conv is not None:
                    close(True)
                conv, state, skip = c, [[], [], 0, ROOT, 0], skipped
            if own and skip:
                skip -= 1
                continue
            if len(state[0]) == BLOCK:
                close(False)
            state[0].append(digest)
            state[1].append(words)
            if len(out) >= ROWS:
                yield sent()
    if conv is not None:
        close(True)
    if out:
        yield sent()


def _ids(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the ids that end at a node, in pieces of bounded length, from rows in order of node and id."""
    names = ["node", "depth", "first", "ids"]
    node, held = None, []
    for batch in rows:
        nodes, depths, ids = (batch.column(i).to_pylist() for i in range(3))
        out = []
        for key, i in zip(zip(nodes, depths, strict=True), ids, strict=True):
            if key != node or len(held) >= IDS:
                if held:
                    out.append((*node, held[0], ",".join(map(str, held))))
                node, held = key, []
            held.append(i)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_schema(names))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, held[0], ",".join(map(str, held)))], schema=_schema(names))


def _schema(names: list[str]) -> pa.Schema:
    kinds = {"node": pa.binary(), "depth": pa.int64(), "first": pa.int64(), "ids": pa.string(), "ends_sha256": pa.string()}
    return pa.schema([(n, kinds[n]) for n in names])


def _hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's whole list, from its pieces in order, without holding the list."""
    node, h = None, None
    for batch in rows:
        out = []
        for key, ids in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    out.append((*node, h.hexdigest()))
                node, h = key, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_schema(["node", "depth", "ends_sha256"]))
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, h.hexdigest())], schema=_schema(["node", "depth", "ends_sha256"]))


def _ends(ended: DataFrame) -> DataFrame:
    """``node``, ``depth`` and the hash of the ids that end there, in order, joined by commas."""
    parts = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["node", "depth", "conv_id"]
    pieces = ended.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_ids, "node binary, depth bigint, first bigint, ids string")
    pieces = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").select("node", "depth", "ids")
    return pieces.mapInArrow(_hashed, "node binary, depth bigint, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``digest``, ``words``, and where beginnings were given ``own``, ``place`` and ``skipped``.
    """
    if "own" not in turns.columns:
        turns = turns.select("*", F.lit(1).alias("own"), F.lit(0).alias("place"), F.lit(0).alias("skipped"))
    order = ("conv_id", "own", "place", "turn", "role", "digest")
    streamed = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "own", "digest", "words", "skipped")
    blocks = written(streamed.mapInArrow(_blocks, BLOCKS), "blocks")

    # Groups of equal blocks after equal prefixes. All their members have the same turns and words.
    equal = blocks.groupBy("before", "after", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("turns").alias("turns"), F.first("words").alias("words"), F.first("words_before").alias("words_before")
    )
    groups = written(equal.withColumn("size", F.size("words")).where(F.col("size") > 0), "groups")
    siblings = groups.groupBy("before").agg((F.count(F.lit(1)) > 1).alias("parted"))
    # A row for each group and turn. ``node`` names the turn's node: by a digest where siblings part, by the block where there is one only.
    parted = attach(groups, siblings, ["before"])
    at = F.posexplode("words").alias("place", "word")
    spread = parted.select("before", "after", "block", "size", "n", "least", "turns", "parted", "words", "words_before", at)
    # Whole blocks go by the same digest as their prefixes of as many turns.
    to_here = F.concat("before", F.expr(f"substring(turns, 1, {DIGEST} * (place + 1))"))
    here = F.substring(F.unhex(F.sha2(to_here, 256)), 1, DIGEST)
    to_parent = F.concat("before", F.expr(f"substring(turns, 1, {DIGEST} * place)"))
    above = F.substring(F.unhex(F.sha2(to_parent, 256)), 1, DIGEST)
    whole = F.col("place") + 1 == F.col("size")
    depth = F.col("block").cast("bigint") * BLOCK + F.col("place") + 1
    boundaries = spread.select(
        F.when(whole | ~F.col("parted"), F.col("after")).otherwise(here).alias("node"),
        depth.alias("depth"),
        F.when(F.col("place") == 0, F.col("before")).when(F.col("parted"), above).otherwise(F.col("after")).alias("parent"),
        "before",
        "after",
        "block",
        "n",
        "least",
        (F.col("words_before") + F.coalesce(F.expr("aggregate(slice(words, 1, place), 0L, (a, w) -> a + w)"), F.lit(0))).alias("words_before"),
    )
    boundaries = written(boundaries, "boundaries")
    nodes = boundaries.groupBy("node", "depth").agg(
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.first("parent").alias("parent"), F.first("words_before").alias("words_before")
    )
    nodes = written(nodes, "nodes")
    children = nodes.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    children = written(children, "children")

    # What each conversation owns: the words before its first own node (all, if it owns none), and whether it owns a leaf.
    nodes_with = nodes.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    owned = nodes_with.groupBy("conv_id").agg(F.min("words_before").alias("shared"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    totals = blocks.where("last").select("conv_id", (F.col("words_before") + F.expr("aggregate(words, 0L, (a, w) -> a + w)")).alias("total"))
    per_conv = totals.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    per_conv = written(per_conv, "owned")
    sums = blocks.select("conv_id", "before", "after", "block").join(per_conv, "conv_id").groupBy("before", "after", "block").agg(
        F.sum("shared").alias("shared"), F.min("shared").alias("least_shared"), F.sum("leaf").alias("leaves")
    )
    # Members own nothing up to their block's end but for the smallest, which has the least before its own.
    key = ["before", "after", "block"]
    weighed = boundaries.join(sums, key)
    rest = F.col("shared") - F.col("least_shared") - (F.col("n") - 1) * F.col("words_before") + F.greatest(F.lit(0), F.col("least_shared") - F.col("words_before"))
    below = weighed.groupBy("node", "depth").agg(F.sum(rest).alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    ended = blocks.where("last").select(F.col("after").alias("node"), (F.col("block").cast("bigint") * BLOCK + F.size("words")).alias("depth"), "conv_id")
    ends = _ends(written(ended, "ended"))
    none = F.sha2(F.lit("").cast("binary"), 256)

    root = blocks.where(F.col("block") == 0).select("conv_id").join(per_conv, "conv_id").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("shared").alias("saved_tokens")
    )
    root = root.where(F.col("n_convs") > 0).select(
        F.lit(ROOT).alias("node"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", "conv_id",
        "saved_tokens", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
    )
    inner = nodes.join(below, ["node", "depth"]).select("node", "depth", "parent", "n_convs", "conv_id", "saved_tokens", "n_leaves")
    every = inner.unionByName(root).join(children, ["node", "depth"], "left").join(ends, ["node", "depth"], "left")
    every = written(every.withColumn("above", F.col("depth") - 1), "trie")
    parents = every.select(F.col("node").alias("parent"), F.col("depth").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return attach(every, parents, ["parent", "above"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
