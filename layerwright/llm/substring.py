"""Substring deduplication by a relative Lempel-Ziv parse of every document.

The reference is the whole corpus, indexed in blocks (see ``exchange``): a window of ``size`` words belongs to the
block that its hash names, with the places where its words start. Every batch of documents is parsed against
every block. Only windows whose anchor - the window's smallest hash of ``ANCHOR`` consecutive words - occurs
twice anywhere are looked up, which a first round of questions finds out; equal windows have equal anchors.

The parse is greedy, left to right: a factor starts at a word whose window the reference holds elsewhere and runs as long as the
next window continues at the next place of the same source. At a factor's boundary the next window
is looked up on its own, so a repeated window across two factors is found too. The factors, each at least
``size`` words long, are the duplicate spans. The result does not depend on how documents fall into batches, but for the
choice of sources.

Defined cases: null and empty texts have no words and keep the empty text; texts shorter than a window lose nothing; rows that repeat
are documents like others, so what they share is repeated; an empty table gives no rows; other columns pass
through unchanged and a result name that clashes gets an underscore.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .exchange import ASKED, answers, asked, dealt, hits_of, in_order, raw_texts
from .hashing import Words, grouped, words_of
from .shared import free_name

#: Words of an anchor, as a share of the window: long enough to be rare, short enough to be sparse.
ANCHOR_SHARE = 0.5
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
FACTORS = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("source", LongType())]))


def _sliding(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (least or greatest) of each ``n`` consecutive values."""
    have, best = 1, values
    while have < n:
        step = min(have, n - have)
        best = pick(best[:-step], best[step:])
        have += step
    return best


def _windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, window hashes, window anchors, and the anchors again, once for each place where one stands."""
    at, hashes = words.windows(size)
    if not len(at):
        return at, hashes, hashes, hashes
    anchor = max(1, int(size * ANCHOR_SHARE))
    span = size - anchor + 1
    grams = np.full(len(words.hashes), NONE)
    gram_at, gram = words.windows(anchor)
    grams[gram_at] = gram
    anchors = _sliding(grams, span, np.minimum)[at]
    chosen = np.zeros(len(grams) + span - 1, "uint64")
    chosen[at + span - 1] = anchors
    return at, hashes, anchors, grams[grams == _sliding(chosen, span, np.maximum)]


class _Batch:
    """The windows of a batch. Words are numbered through the batch, so a place names one."""

    def __init__(self, docs: pa.Table, size: int):
        self.docs = in_order(docs)
        self.texts = raw_texts(self.docs)
        self.batch = docs.column("batch")[0].as_py() if docs.num_rows else -1
        at, hashes, anchors, stood, counts, base = [], [], [], [], [], 0
        for some in grouped(self.texts):
            words = words_of(self.texts[some])
            a, h, anchor, places = _windows(words, size)
            at.append(a + base)
            hashes.append(h)
            anchors.append(anchor)
            stood.append(places)
            counts.append(np.diff(words.first))
            base += len(words.hashes)
        joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.at, self.hashes, self.anchors = joined(at, "int64"), joined(hashes, "uint64"), joined(anchors, "uint64")
        self.stood, self.counts = joined(stood, "uint64"), joined(counts, "int64")

    def anchor_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and whether each stands at more than one place."""
        keys, times = np.unique(self.stood, return_counts=True)
        return keys, times > 1

    def candidates(self, keys: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Windows whose anchor is repeated."""
        return np.flatnonzero(repeated[np.searchsorted(keys, self.anchors)]) if len(keys) else np.zeros(0, "int64")


def dedup(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """The rows of ``docs`` without ``text`` (unless ``keep_text``), with ``n_words``, ``n_removed``, ``kept`` and ``factors``.

    ``kept`` holds the words outside all repeated windows of ``size`` words, joined by spaces. ``factors`` holds the parse:
    first word, words, and the source's place (batch, and word in the batch, in the upper and lower 32 bits).
    """
    dealt_docs, _, blocks = dealt(docs, id_col, text)
    kinds = dealt_docs.schema["row"].dataType
    taken = docs.drop(text) if not keep_text else docs
    n_words, n_removed, kept, factors = (free_name(taken, n) for n in ("n_words", "n_removed", "kept", "factors"))
    made = [StructField("_words", LongType()), StructField("_removed", LongType()), StructField("_kept", StringType()), StructField("_factors", FACTORS)]
    schema = StructType([StructField("row", kinds), *([StructField("raw", StringType())] if keep_text else []), *made])

    def ask_anchors(batch: pa.Table) -> pa.Table:
        b = _Batch(batch, size)
        return asked(b.batch, *b.anchor_keys(), None, blocks)

    def looked_up(docs: pa.Table, replies: pa.Table) -> tuple[_Batch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[dict]]:
        b, rows = _Batch(docs, size), replies.to_pylist()
        keys, _ = b.anchor_keys()
        repeated, _ = hits_of(keys, blocks, (r for r in rows if r["stage"] == 1))
        found = b.candidates(keys, repeated)
        windows, first, back = np.unique(b.hashes[found], return_index=True, return_inverse=True)
        return b, found, windows, first, back, rows

    def ask_windows(docs: pa.Table, replies: pa.Table) -> pa.Table:
        b, found, windows, first, back, _ = looked_up(docs, replies)
        many = np.bincount(back, minlength=len(windows)) > 1
        return asked(b.batch, windows, many, b.at[found[first]] if len(found) else first, blocks)

    def parse(docs: pa.Table, replies: pa.Table) -> pa.Table:
        b, found, windows, first, back, rows = looked_up(docs, replies)
        hit, source = hits_of(windows, blocks, (r for r in rows if r["stage"] == 2))
        here = found[hit[back]]
        places = b.at[here]
        of = back[hit[back]]
        own = (np.uint64(max(b.batch, 0)) << np.uint64(32)) | b.at[found[first[of]]].astype("uint64")
        sources = np.where(here == found[first[of]], source[of], own)
        begin = np.flatnonzero((np.diff(places, prepend=-9) != 1) | (np.diff(sources, prepend=NONE) != 1))
        starts = places[begin]
        lengths = np.diff(np.append(begin, len(places))) + size - 1
        total = int(b.counts.sum())
        edges = np.zeros(total + 1, "int64")
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + lengths, -1)
        free = np.cumsum(edges)[:-1] == 0
        cut = np.concatenate([[0], np.cumsum(b.counts)])
        of_doc = np.searchsorted(starts, cut)
        removed = np.add.reduceat(np.append(~free, False), cut[:-1]) * (b.counts > 0) if len(b.counts) else b.counts
        kept_texts = []
        for i, t in enumerate(b.texts):
            words = (t or b"").split()
            kept_texts.append(b" ".join(words if not removed[i] else itertools.compress(words, free[cut[i] : cut[i + 1]].tolist())).decode())
        shift = np.repeat(cut[:-1], np.diff(of_doc))
        parsed = pa.StructArray.from_arrays(
            [pa.array(starts - shift, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sources[begin].astype("int64"))],
            names=["start", "length", "source"],
        )
        columns = {"row": b.docs.column("row")}
        if keep_text:
            columns["raw"] = b.docs.column("raw").cast(pa.string())
        columns |= {
            "_words": pa.array(b.counts, pa.int64()),
            "_removed": pa.array(removed, pa.int64()),
            "_kept": pa.array(kept_texts, pa.string()),
            "_factors": pa.ListArray.from_arrays(pa.array(of_doc, pa.int32()), parsed),
        }
        return pa.table(columns)

    batches = dealt_docs.groupBy("batch")
    repeated = answers(batches.applyInArrow(ask_anchors, ASKED), 1)
    windows = batches.cogroup(repeated.groupBy("batch")).applyInArrow(ask_windows, ASKED)
    replies = repeated.unionByName(answers(windows, 2))
    out = batches.cogroup(replies.groupBy("batch")).applyInArrow(parse, schema)
    whole = [F.col("raw").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in taken.columns]
    return out.select(*whole, F.col("_words").alias(n_words), F.col("_removed").alias(n_removed), F.col("_kept").alias(kept), F.col("_factors").alias(factors))
