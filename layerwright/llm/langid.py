"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for each piece of the vocabulary. A word's probability is the sum over all ways to cut it into
pieces, by the forward algorithm; a text's is the product over its words. The pieces' probabilities are learned from the words
of the labelled texts, counted by Spark, by rounds of expectation and maximisation that start from equal
probabilities. Only expected counts by language and piece, whose number the vocabulary bounds, come to the driver.

Words are lower-cased and reduced to their letters. A word of any length is summed over all its segmentations when a text is scored: the sums are
rescaled as they go. Learning reads words of more than ``LONGEST`` letters as words of that many.

The logs of the ``SENT`` words that are most frequent in what was learned are computed once and sent to the tasks, which compute those of other words
themselves, once a task while it keeps them. Where a word's logs come from does not change them.

Defined cases: a text that is null or has no letter, and any text if nothing was learned, gets ``und`` with score 0; rows
that repeat count each in learning; ties go to the language first in order; an empty table gives no rows; other columns
pass through and a result name that clashes gets an underscore.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .hashing import between, grouped, running, words_of
from .memo import Memo
from .shared import free_name, written

LONGEST, ROUNDS = 24, 2
#: Frequent words whose logs are sent: a bound on what is sent, not on what is scored.
SENT = 1 << 18
#: Positions after which running sums are scaled.
SCALED = 16
#: Added to every expected count; probability of a character that is no piece, and least probability of all.
ADDED, UNKNOWN = 0.5, 1e-8
NO_LANGUAGE = "und"
SPACE = "▁"
_BASE = 0x9E3779B97F4A7C15
#: Positions times languages of a table of forward sums.
TABLE = 2 << 20


class Vocabulary:
    """The lower-case pieces of letters, found by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        plain = sorted({p for p in pieces if p == SPACE or ((s := p.removeprefix(SPACE)).isalpha() and s == s.lower())})
        self.size, self.longest = len(plain), max(map(len, plain))
        hashes = np.array([_hashes(p, np.array([0]), np.array([len(p)]))[0] for p in plain], "uint64")
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        #: Whether any piece's hash begins with these bits.
        self.begun = np.zeros(1 << 20, bool)
        self.begun[hashes >> np.uint64(44)] = True

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Where each word's positions begin and end, and for each end, counted from the word's start, the edges into it, a pair of
        arrays for each length: end positions and piece numbers; a character that is no piece has the number ``size``."""
        text = "".join(SPACE + w for w in words)
        length = np.array([len(w) + 1 for w in words], "int64")
        begin = np.cumsum(length) - length
        place = np.arange(len(text)) - np.repeat(begin, length)
        owner = np.repeat(np.arange(len(words)), length)
        sums = running(_points(text), _BASE)
        by_end: list[list] = [[] for _ in range(int(length.max(initial=0)) + 1)]
        for n in range(1, self.longest + 1):
            end = np.flatnonzero(place >= n - 1)
            h = between(sums, end - n + 1, end + 1, _BASE)
            if n > 1:
                some = self.begun[h >> np.uint64(44)]
                end, h = end[some], h[some]
            at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
            found = self.hashes[at] == h
            number = np.where(found, self.numbers[at], self.size)
            if n > 1:
                end, number = end[found], number[found]
            order = np.argsort(place[end], kind="stable")
            end, number = end[order], number[order]
            cuts = np.searchsorted(place[end], np.arange(len(by_end)))
            for i in range(len(by_end) - 1):
                lo, hi = cuts[i], cuts[i + 1]
                if hi > lo:
                    # Position p of word w stands at p + w + 1, after the word's start at begin + w.
                    by_end[i + 1].append((n, end[lo:hi] + owner[end[lo:hi]] + 1, number[lo:hi]))
        return begin + np.arange(len(words)), begin + np.arange(len(words)) + length, by_end


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype("uint64") * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)


def _hashes(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return between(running(_points(text), _BASE), starts, ends, _BASE)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _portions(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Words in order of length, as many at a time as have ``most`` letters together, one at least."""
    order = np.argsort(sizes, kind="stable")
    total, start = np.cumsum(sizes[order]), 0
    while start < len(order):
        end = max(start + 1, int(np.searchsorted(total, total[start] - sizes[order[start]] + most, side="right")))
        yield order[start:end]
        start = end


def forward(words: list[str], pieces: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Log probability of each word (rows) in each language (columns); ``p`` has a row for each piece and one more for unknown characters."""
    out = np.zeros((len(words), p.shape[1]))
    for some in _portions(np.array([len(w) + 2 for w in words], "int64"), max(1, TABLE // p.shape[1])):
        starts, ends, by_end = pieces.edges([words[i] for i in some.tolist()])
        sums, scale = np.zeros((int(ends[-1]) + 1, p.shape[1])), np.zeros((len(some), p.shape[1]))
        sums[starts] = 1
        for i, edges in enumerate(by_end):
            for n, at, number in edges:
                sums[at] += sums[at - n] * p[number]
            if i and i % SCALED == 0:
                going = np.flatnonzero(starts + i < ends)
                recent = starts[going, None] + np.arange(max(0, i - pieces.longest), i + 1)
                top = sums[recent].max(1)
                sums[recent] /= top[:, None]
                scale[going] += np.log(top)
        out[some] = np.log(sums[ends]) + scale
    return out


def expected(words: list[str], times: np.ndarray, pieces: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected number of each piece in all segmentations of the words, each counted ``times``."""
    out, step = np.zeros(len(p)), max(1, TABLE // (LONGEST + 2))
    for a in range(0, len(words), step):
        starts, ends, by_end = pieces.edges(words[a : a + step])
        ahead, back = np.zeros(int(ends[-1]) + 1), np.zeros(int(ends[-1]) + 1)
        ahead[starts] = 1
        for edges in by_end:
            for n, at, number in edges:
                ahead[at] += ahead[at - n] * p[number]
        back[ends] = times[a : a + step] / ahead[ends]
        for edges in reversed(by_end):
            for n, at, number in edges:
                share = back[at] * p[number]
                out += np.bincount(number, weights=share * ahead[at - n], minlength=len(p)) if len(number) > 64 else _few(number, share * ahead[at - n], len(p))
                back[at - n] += share
    return out


def _few(number: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size)
    np.add.at(out, number, weights)
    return out


def _plain(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def word_lists(texts: list[bytes | None], cut: bool = False) -> Iterator[tuple[slice, list[str], np.ndarray, np.ndarray]]:
    """For each group of texts: its place, its distinct words, and for each word of a text the text and the word's number. ``cut`` gives long words in parts."""
    for some in grouped(texts):
        words = words_of(texts[some])
        raw = words.raw.tobytes()
        _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        names: dict[str, int] = {}
        parts, sizes = [], []
        for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True):
            w = _plain(raw[a:b].decode())
            pieces = [w][: len(w)] if len(w) <= LONGEST or not cut else [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)]
            parts += [names.setdefault(c, len(names)) for c in pieces]
            sizes.append(len(pieces))
        sizes, parts = np.array(sizes, "int64"), np.array(parts, "int64")
        begin = np.cumsum(sizes) - sizes
        count = sizes[back]
        at = np.repeat(begin[back], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield some, list(names), np.repeat(words.owner, count), parts[at]


def count_words(labelled: DataFrame, lang: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object).astype(str)
            for some, words, owner, number in word_lists(batch.column(1).to_pylist(), cut=True):
                names, of = np.unique(langs[some], return_inverse=True)
                both, n = np.unique(of[owner] * len(words) + number, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[both // max(1, len(words))].tolist(), pa.string()),
                        pa.array([words[i] for i in (both % max(1, len(words))).tolist()], pa.string()),
                        pa.array(n, pa.int64()),
                    ],
                    names=["lang", "word", "n"],
                )

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.col(text).cast("string").cast("binary"))
    return rows.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """The languages, in order; the probabilities: a row for each piece and one for unknown characters, a column for
    each language; and frequent words with the logs of their probabilities."""

    languages: list[str]
    p: np.ndarray
    words: list[str]
    logs: np.ndarray


def learn(labelled: DataFrame, path: str, lang: str = "lang", text: str = "text", rounds: int = ROUNDS) -> Model:
    """A model of the labelled texts."""
    counted = written(count_words(labelled, lang, text), "words")
    context = labelled.sparkSession.sparkContext
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    size = vocabulary(path).size
    p = np.full((size + 1, len(languages)), 1 / size)
    p[size] = UNKNOWN
    for _ in range(rounds if languages else 0):
        shared = context.broadcast((languages, p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, p = shared.value
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                langs = np.array(batch.column(0).to_pylist(), object).astype(str)
                words, n = np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy(zero_copy_only=False)
                for name in np.unique(langs).tolist():
                    here = langs == name
                    found = expected(words[here].tolist(), n[here].astype("float64"), vocabulary(path), p[:, names.index(name)])
                    sums[name] = sums.get(name, 0) + found
            for name, found in sums.items():
                some = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(found[some])], names=["lang", "piece", "n"]
                )

        totals = counted.mapInArrow(run, "lang string, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(p)
        counts[totals["piece"].to_numpy(), [languages.index(x) for x in totals["lang"]]] = totals["n"]
        p = np.maximum((counts + ADDED) / (counts[:size].sum(0) + ADDED * size), UNKNOWN)
        p[size] = UNKNOWN
    return Model(languages, p, *_frequent(counted, path, p))


def _frequent(counted: DataFrame, path: str, p: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The ``SENT`` most frequent whole words and their logs."""
    context = counted.sparkSession.sparkContext
    total = counted.where(F.length("word") < LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    top = total.orderBy(F.desc("n"), "word").limit(SENT).select("word")
    shared = context.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = forward(batch.column(0).to_pylist(), vocabulary(path), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in logs], pa.binary())], names=["word", "logs"])

    found = top.repartition(context.defaultParallelism).mapInArrow(run, "word string, logs binary").toPandas() if p.shape[1] else None
    if found is None or not len(found):
        return [], np.zeros((0, p.shape[1]))
    return found["word"].tolist(), np.frombuffer(b"".join(map(bytes, found["logs"])), "float64").reshape(-1, p.shape[1])


def predict(docs: DataFrame, model: Model, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the language's share of the text's probability over all languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    raw = free_name(docs, "_raw")
    schema = StructType([*docs.schema.fields, StructField(free_name(docs, "lang_pred"), StringType()), StructField(free_name(docs, "score"), DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = model.languages
        names = np.array([*languages, NO_LANGUAGE], object)
        logs_of = Memo(lambda words: forward(words, vocabulary(path), model.p), model.words, model.logs)
        for batch in batches:
            for some, words, owner, number in word_lists(batch.column(batch.num_columns - 1).to_pylist()):
                n = some.stop - some.start
                best, share = np.full(n, len(languages)), np.zeros(n)
                if languages and len(number):
                    logs = logs_of(words)
                    sums = np.stack([np.bincount(owner, weights=logs[number, j], minlength=n) for j in range(len(languages))], 1)
                    known = np.bincount(owner, minlength=n) > 0
                    best = np.where(known, sums.argmax(1), len(languages))
                    share = np.where(known, 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1), 0.0)
                part = batch.slice(some.start, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names[best].tolist(), pa.string()), pa.array(share)], names=schema.names)

    return docs.withColumn(raw, F.col(text).cast("string").cast("binary")).mapInArrow(run, schema)
