"""Collocations: phrases of two and three words that occur together more often than their parts would by chance.

The corpus is parsed without prefixes in common: a word whose hash says so begins a chunk, so equal passages are cut alike
wherever they stand, and a chunk goes on for two words into the next one. Equal chunks are one row of a dictionary with the
number of times the parse has them. Sequences of one to three words are counted inside the distinct chunks only, each
weighted by the chunk's number; one that lies in two chunks belongs to the chunk that it begins in, so it counts once.

The dictionary is dealt to batches of a few MB, as packed lots of chunks, and a batch puts equal chunks together. It tells blocks the
hashes of its sequences and their numbers (no number above the least that matters), and learns which may be frequent enough; only those it spells
out, and these are counted exactly. Hash collisions cost a spelled sequence more and change no count. A sequence is named once by
a batch, however often it occurs, and chunks that a third of all documents share are one entry, so nothing is crowded.

Text is lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and U+000A to U+000D, pieces into words at spaces and tabs.
All counts are by language; a null language is ``und``.

Defined cases: null and empty texts add nothing; a text without any cut is one piece, of any length; rows that repeat count each;
ties in rank go to the higher count, then to the phrase first in byte order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import grouped, mixed
from .hot import attach
from .ordering import numbered
from .shared import fresh_path, written

NO_LANGUAGE = "und"
#: Words of the longest phrase.
LONGEST = 3
#: One word in so many begins a chunk; words after which a chunk ends anyway.
EVERY, CHUNK_WORDS = 16, 64
#: Bytes of text parsed at once, bytes of text whose chunks share a batch, and bytes of text whose sequences share a block.
AT_ONCE, BATCH_BYTES, BLOCK_BYTES = 4 << 20, 5 << 20, 10 << 20
_PLAIN = bytearray(range(256))
_PLAIN[65:91] = bytes(range(97, 123))
_PLAIN[9] = 32
for _end in b".,;:!?\x0a\x0b\x0c\x0d":
    _PLAIN[_end] = 10
_PLAIN = bytes(_PLAIN)
_STEP = np.uint64(0x9E3779B97F4A7C15)
LOTS = "batch int, lang string, chunks binary, times binary"
TOLD = "block int, batch int, keys binary, times binary"
HEARD = "batch int, block int, hits binary"
COUNTED = "lang string, phrase string, size int, n bigint"


class _Triggers(dict):
    """Whether a word begins a chunk."""

    def __missing__(self, word: bytes) -> bool:
        found = self[word] = zlib.crc32(word) % EVERY == 0
        return found


def chunks(words: list[bytes], begins: _Triggers) -> Iterator[bytes]:
    """The chunks of a piece: words joined by spaces, and at the end a space for each word that is not the chunk's own but the next one's."""
    n = len(words)
    ends = [i for i, found in enumerate(map(begins.__getitem__, words)) if found and i]
    if not ends and n <= CHUNK_WORDS:
        if n:
            yield b" ".join(words)
        return
    at = 0
    for end in (*ends, n):
        while at < end:
            stop = min(end, at + CHUNK_WORDS)
            ahead = min(n - stop, LONGEST - 1)
            yield b" ".join(words[at : stop + ahead]) + b" " * ahead
            at = stop


def parsed(texts: list[bytes]) -> Counter:
    """The distinct chunks of some texts, and how often the parse has each."""
    begins, times = _Triggers(), Counter()
    for piece, n in Counter(b"\n".join(texts).translate(_PLAIN).split(b"\n")).items():
        for chunk in chunks(piece.split(), begins):
            times[chunk] += n
    return times


def _lots(docs: DataFrame, lang: str, text: str, batches: int) -> DataFrame:
    """The parse as packed lots: chunks of a language for a batch, a line each, and the numbers of each."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for part in parts:
            langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for some in grouped(texts, AT_ONCE):
                by_lang: dict[str, list[bytes]] = {}
                for name, t in zip(langs[some], texts[some], strict=True):
                    by_lang.setdefault(name, []).append(t)
                for name, found in by_lang.items():
                    times = parsed(found)
                    lots: dict[int, tuple[list, list]] = {}
                    for chunk, n in times.items():
                        lot = lots.setdefault(zlib.crc32(chunk) % batches, ([], []))
                        lot[0].append(chunk)
                        lot[1].append(n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(lots), pa.int32()),
                            pa.array([name] * len(lots), pa.string()),
                            pa.array([pack(b"\n".join(c)) for c, _ in lots.values()], pa.binary()),
                            pa.array([pack(np.asarray(n, "<i8").tobytes()) for _, n in lots.values()], pa.binary()),
                        ],
                        names=["batch", "lang", "chunks", "times"],
                    )

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)), F.col(text).cast("string").cast("binary").alias("raw"))
    return rows.where(F.octet_length("raw") > 0).mapInArrow(run, LOTS)


def dictionary(lots: pa.Table) -> dict[str, dict[bytes, int]]:
    """The distinct chunks of a batch's lots by language, in one order whatever the lots' order, and the number of each."""
    import zstandard

    unpack, out = zstandard.ZstdDecompressor().decompress, {}
    for lot in lots.select(["lang", "chunks", "times"]).to_pylist():
        known = out.setdefault(lot["lang"], {})
        get = known.get
        for chunk, n in zip(unpack(lot["chunks"]).split(b"\n"), np.frombuffer(unpack(lot["times"]), "<i8").tolist(), strict=True):
            known[chunk] = get(chunk, 0) + n
    return out


class _Sequences:
    """All sequences in the distinct chunks of a batch, each with its chunk's number, and keys that any batch finds alike."""

    def __init__(self, lots: pa.Table, blocks: int):
        import xxhash

        found = dictionary(lots)
        self.langs = list(found)
        text = b"\n".join([chunk for some in found.values() for chunk in some]) + b"\n"
        raw = np.frombuffer(text, "uint8")
        ends = np.flatnonzero((raw == 32) | (raw == 10)) + 1
        closes = raw[ends - 1] == 10
        offsets = np.concatenate([[0], ends]).astype("int32")
        spaced = text.replace(b"\n", b" ")
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(spaced)]).dictionary_encode()
        chunk = np.cumsum(closes) - closes
        real = np.diff(offsets) > 1
        number, chunk = words.indices.to_numpy()[real].astype("int64"), chunk[real]
        marks = np.bincount(np.repeat(np.arange(closes.sum()), np.diff(np.flatnonzero(closes), prepend=-1))[~real], minlength=closes.sum())
        sizes = np.bincount(chunk, minlength=len(marks))
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(number))
        owned = left > marks[chunk]
        lang = np.repeat(np.arange(len(found)), [len(x) for x in found.values()])[chunk]
        self.n = np.fromiter((n for some in found.values() for n in some.values()), "int64")[chunk]
        self.words = np.bincount(lang[owned], weights=self.n[owned], minlength=len(found))
        # A word of a language is a number; the numbers of a sequence's words make the sequence's number.
        both = number * len(found) + lang
        seen = np.zeros(len(words.dictionary) * len(found), bool)
        seen[both] = True
        self.word = (np.cumsum(seen) - 1)[both].astype("uint64")
        both = np.flatnonzero(seen)
        self.lang_of = (both % max(1, len(found))).tolist()
        self.spelled = [w[:-1] for w in words.dictionary.take(pa.array(both // max(1, len(found)))).to_pylist()]
        if len(both) ** LONGEST >= 1 << 64:
            raise ValueError("a batch has too many distinct words for a sequence's number")
        self.base = np.uint64(max(2, len(both)))
        names = [x.encode() + b"\n" for x in self.langs]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(names[x] + w) for x, w in zip(self.lang_of, self.spelled, strict=True)), "uint64", len(both))[self.word]
        self.at = [np.flatnonzero(owned & (left >= size)) for size in range(1, LONGEST + 1)]
        keys = []
        for size, at in enumerate(self.at, 1):
            h = hashes[at] + np.uint64(size)
            for k in range(1, size):
                h = mixed(h * _STEP + hashes[at + k])
            keys.append(((h >> np.uint64(32)) % np.uint64(blocks) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        keys = np.concatenate(keys)
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]
        self.first = np.flatnonzero(np.diff(self.sorted, prepend=~self.sorted[:1]))

    def keys(self) -> np.ndarray:
        """The distinct keys, in order: a block's number in the upper 32 bits, the key in the block in the lower ones."""
        return self.sorted[self.first]

    def times(self) -> np.ndarray:
        """How often each key's sequences occur."""
        every = self.n[np.concatenate(self.at)][self.order]
        return np.add.reduceat(every, self.first) if len(self.first) else every

    def spell(self, hit: np.ndarray) -> Iterator[tuple[int, list[str], list[bytes], list[int]]]:
        """For each size, the sequences whose key is ``hit``: languages, phrases and how often each occurs."""
        marked = np.zeros(len(self.order), bool)
        marked[self.order] = np.repeat(hit, np.diff(np.append(self.first, len(self.order))))
        for size, (at, here) in enumerate(zip(self.at, np.split(marked, np.cumsum([len(x) for x in self.at])[:-1]), strict=True), 1):
            at = at[here]
            number = self.word[at]
            for k in range(1, size):
                number = number * self.base + self.word[at + k]
            order = np.argsort(number)
            number = number[order]
            fresh = np.flatnonzero(np.diff(number, prepend=~number[:1]))
            if not len(fresh):
                continue
            words = [self.word[at[order[fresh]] + k].tolist() for k in range(size)]
            phrases = [b" ".join([self.spelled[w] for w in some]) for some in zip(*words, strict=True)]
            yield size, [self.langs[self.lang_of[w]] for w in words[0]], phrases, np.add.reduceat(self.n[at][order], fresh).tolist()


def frequent(docs: DataFrame, least: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``phrase``, ``size``, ``n``: all sequences that occur ``least`` times or more, with exact numbers; size 0 is the number of the language's words."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("bigint"))).first()[0] or 0
    batches, blocks = max(1, -(-total // BATCH_BYTES)), max(1, -(-total // BLOCK_BYTES))
    most = min(least, 255)

    def tell(lots: pa.Table) -> pa.Table:
        found = _Sequences(lots, blocks)
        keys, times = found.keys(), np.minimum(found.times(), most).astype("uint8")
        block = (keys >> np.uint64(32)).astype("int64")
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(keys))
        low, parts = keys.astype("<u4"), list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
        return pa.table(
            {
                "block": pa.array(block[cuts[:-1]], pa.int32()),
                "batch": pa.array([lots.column("batch")[0].as_py()] * len(parts), pa.int32()),
                "keys": pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()),
                "times": pa.array([times[a:b].tobytes() for a, b in parts], pa.binary()),
            }
        )

    def hear(block: pa.Table) -> pa.Table:
        lists = [np.frombuffer(k, "<u4") for k in block.column("keys").to_pylist()]
        keys = np.concatenate(lists)
        order = np.argsort(keys)
        first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
        times = np.add.reduceat(np.frombuffer(b"".join(block.column("times").to_pylist()), "uint8")[order].astype("int32"), first)
        hit = np.zeros(len(keys), bool)
        hit[order] = np.repeat(times >= most, np.diff(np.append(first, len(keys))))
        cuts = np.cumsum([len(x) for x in lists])
        return pa.table(
            {
                "batch": block.column("batch"),
                "block": block.column("block"),
                "hits": pa.array([np.packbits(m).tobytes() for m in np.split(hit, cuts[:-1])], pa.binary()),
            }
        )

    def spell(lots: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if lots.num_rows:
            found = _Sequences(lots, blocks)
            keys = found.keys()
            block = keys >> np.uint64(32)
            hit = np.zeros(len(keys), bool)
            for r in replies.select(["block", "hits"]).to_pylist():
                a, b = np.searchsorted(block, np.array([r["block"], r["block"] + 1], "uint64"))
                hit[a:b] = np.unpackbits(np.frombuffer(r["hits"], "uint8"), count=b - a)
            every = [(0, found.langs, [b""] * len(found.langs), found.words.astype("int64").tolist()), *found.spell(hit)]
            for size, langs, phrases, times in every:
                for column, values in zip(out, (langs, phrases, [size] * len(langs), times), strict=True):
                    column += values
        kinds = (pa.string(), pa.binary(), pa.int32(), pa.int64())
        columns = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
        return pa.table([columns[0], columns[1].cast(pa.string()), *columns[2:]], names=["lang", "phrase", "size", "n"])

    lots = _lots(docs, lang, text, batches).groupBy("batch")
    replies = lots.applyInArrow(tell, TOLD).groupBy("block").applyInArrow(hear, HEARD)
    spelled = lots.cogroup(replies.groupBy("batch")).applyInArrow(spell, COUNTED)
    counted = spelled.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least) | (F.col("size") == 0))


def _cuts(size: int) -> list:
    """The two parts of a phrase of ``size`` words for each place to cut it."""
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a + 1, n), " ")
    return [F.struct(F.lit(k).alias("k"), part(0, k).alias("first"), part(k, size - k).alias("rest")) for k in range(1, size)]


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a`` is the phrase's number, ``l`` and ``r`` those of the parts it is cut into, ``n`` the number of the language's words, and
    ``score`` the floor of ``1000000 a a / (l r)``, least over the cuts. A phrase needs ``a >= least``; one that lies in a longer phrase with at least
    ``inside`` per cent of its number is left out.
    """
    every = written(frequent(docs, least, lang, text), "sequences")
    words = every.where(F.col("size") == 0).select("lang", "n")
    counted = every.where(F.col("size") > 0)
    part = counted.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))

    phrases = counted.where(F.col("size") > 1).withColumnRenamed("n", "a")
    cut = F.explode(F.when(F.col("size") == 2, F.array(*_cuts(2))).otherwise(F.array(*_cuts(3))))
    rows = phrases.select("lang", "phrase", "size", "a", cut.alias("cut")).select("lang", "phrase", "size", "a", "cut.*")
    named = lambda by, to: part.select("lang", F.col("part").alias(by), F.col("times").alias(to))
    rows = written(attach(rows, named("first", "l"), ["lang", "first"]), "cuts")
    rows = attach(rows, named("rest", "r"), ["lang", "rest"])
    number = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {number('a')} * {number('a')}) div ({number('l')} * {number('r')})")
    scored = rows.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    pair = F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, 2), " ")))
    longer = phrases.where(F.col("size") > 2).select("lang", pair.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stay = F.col("longer").isNull() | (F.col("size") > 2) | (100 * F.col("longer") < inside * F.col("a"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(stay).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # Ranks are places in one order of all phrases, less the place of the language's first, so no task sorts a language alone.
    order = ("lang", F.col("score").desc(), F.col("a").desc(), "phrase")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(kept, "scored").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows, _ = numbered(dealt, fresh_path(docs.sparkSession, "ranked"))
    first = words.join(rows.groupBy("lang").agg(F.min("number").alias("first")), "lang")
    ranked = attach(rows, first, ["lang"]).withColumn("rank", F.col("number") - F.col("first") + 1).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
