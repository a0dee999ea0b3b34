"""Quality rules: counted features of a text, and character perplexity within bands of its language.

The model is a modified Kneser-Ney model of order ``ORDER`` over the characters of words, one for each language. Spark
counts the words of every text and from them the n-grams, the distinct left contexts of the lower orders, the counts of
counts and the context totals, and gives every n-gram its probability, by joins from the lowest order up. No n-gram is left out,
whatever the input. Each distinct word of a language is scored once, by a join of its n-grams with their probabilities.

Texts meet the scores of their words in two ways that give the same sums: the scores of the most frequent words, at most ``SENT``
and those the most frequent by powers of two, are sent to the executors; a text's other words, none of which is frequent, are joined.

The bands are of the logarithm, within a language. The lower edge is a share of the median: the share that the language's lowest
tenth keeps, to the power that makes it ``SPREADS`` spreads, and ``MOST_LOW`` at most; it is above 0. The upper edge is ``SPREADS``
spreads (the middle 80 % of its language, as standard deviations) above the median, and ``LEAST_BAND`` at least. Texts that
mix languages, or bear the wrong one, are no junk: a text beyond the upper edge is rejected only if its excess is beyond that reach
as well. A word's excess is its sum above its language's mean, taken in the language that gives the least, of those with ``ENOUGH``
texts that have the word. Languages of fewer than ``ENOUGH`` scored texts reject none.

Defined cases: null texts have no words, null languages count as one language of their own; texts without words have no
perplexity; repeated rows count each; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .hashing import Words, grouped, mixed, words_of
from .shared import free_name, written

ORDER = 4
#: N-grams an order of the small model that ``fit`` gives; the corpus is not scored by it.
MOST = 1 << 19
#: Words whose scores are sent to every executor.
SENT = 1 << 20
#: N-grams whose probabilities are sent to every executor.
SENT_GRAMS = 1 << 19
SPREADS, LEAST_BAND, MOST_LOW, ENOUGH = 8.0, 0.5, 0.85, 30
NO_LANGUAGE = "und"
#: Rows of bands, one for each language, up to which they are sent to every executor.
FEW = 10_000
#: Words that a worker scores at once, which bounds its memory.
WORDS_AT_ONCE = 16_384
SYMBOLS = b"#*$%&|<>"
#: What words are scored by.
VALUES = ["surprise", "excess"]
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(NO_LANGUAGE))


def features(texts: list[bytes | None], words: Words) -> dict[str, np.ndarray]:
    """The counted features of each text."""
    n = len(texts)
    count = np.diff(words.first)
    lead = (words.raw & 0xC0) != 0x80
    inside = np.zeros(len(words.raw) + 1, "int32")
    inside[words.starts] += 1
    inside[words.ends] -= 1
    chars = np.cumsum(lead & (np.cumsum(inside[:-1]) > 0))
    symbols = np.cumsum(np.isin(words.raw, np.frombuffer(SYMBOLS, "uint8")))
    size = np.array([len(t or b"") + 1 for t in texts], "int64")
    last = np.cumsum(size) - 1 if n else size
    per_text = lambda total: np.diff(total[last], prepend=0) if n else size
    repeated_lines = []
    for t in texts:
        lines = [x for x in (t or b"").split(b"\n") if x.strip(b" \t\n\v\f\r")]
        repeated_lines.append(len(lines) - len(set(lines)))
    at, hashes = words.windows(3)
    covered = np.zeros(len(words.hashes) + 1, "int32")
    if len(at):
        owner = words.owner[at]
        order = np.lexsort((hashes, owner))
        same = (np.diff(hashes[order]) == 0) & (np.diff(owner[order]) == 0)
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered[at[twice]] += 1
        covered[at[twice] + 3] -= 1
    repeats = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return {
        "n_words": count,
        "word_chars": per_text(chars),
        "n_symbols": per_text(symbols),
        "n_dup_lines": np.array(repeated_lines, "int64"),
        "n_repeat_words": np.diff(repeats[words.first]),
    }


def _word_keys(words: Words, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the texts' languages; for each word the number of its name, and a hash of language and word."""
    names, of = np.unique(langs.astype(str), return_inverse=True)
    salt = np.array([int.from_bytes(blake2b(n.encode(), digest_size=8).digest(), "little") for n in names.tolist()], "uint64")
    owner = of[words.owner]
    return names, owner, mixed(words.hashes ^ salt[owner])


def count_words(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang``, ``word`` and its number ``n``: the words of all texts, counted in each task and then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), np.array(batch.column(0).to_pylist(), object)
            for some in grouped(texts):
                words = words_of(texts[some])
                names, owner, keys = _word_keys(words, langs[some])
                _, first, back = np.unique(keys, return_index=True, return_inverse=True)
                raw = words.raw.tobytes()
                spelled = [raw[a:b].decode() for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[owner[first]].tolist(), pa.string()), pa.array(spelled, pa.string()), pa.array(np.bincount(back, minlength=len(first)), pa.int64())],
                    names=["lang", "word", "n"],
                )

    rows = docs.select(_language(F.col(lang)), F.col(text).cast("string").cast("binary"))
    return rows.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def keyed(words: DataFrame) -> DataFrame:
    """Counted words with ``key``, the hash of language and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, spelled, n = batch.columns
            _, _, keys = _word_keys(words_of(spelled.cast(pa.binary()).to_pylist()), np.array(langs.to_pylist(), object))
            yield pa.RecordBatch.from_arrays([langs, spelled, n, pa.array(keys.view("int64"))], names=["lang", "word", "n", "key"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, word string, n bigint, key bigint")


def _grams() -> Column:
    """A gram of up to ``ORDER`` characters for each character of ``word`` and for its end, a space standing for the word's
    edges. Shorter grams start at the word's edge."""
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    ends = F.sequence(F.lit(2), F.length("word") + 2)
    return F.transform(ends, lambda e: F.substring(padded, F.greatest(F.lit(1), e - (ORDER - 1)), F.least(e, F.lit(ORDER))))


def count_grams(words: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n``: the words' grams and their numbers."""
    return words.select("lang", F.explode(_grams()).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _levels(words: DataFrame) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The words' grams, and the counts of each order: occurrences in the highest, distinct left contexts below."""
    grams = written(count_grams(words), "grams")
    level = {ORDER: grams.where(F.length("gram") == ORDER)}
    for order in range(ORDER - 1, 0, -1):
        # Left contexts of the next order's grams; a gram at the word's edge has none and counts as it is.
        below = level[order + 1].select("lang", F.substring("gram", 2, order).alias("gram")).groupBy("lang", "gram").agg(F.count("gram").alias("n"))
        if order > 1:
            below = below.unionByName(grams.where(F.length("gram") == order))
        level[order] = written(below.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lower")
    return grams, level


def _sent_if_few(by_language: DataFrame, languages: int) -> DataFrame:
    return F.broadcast(by_language) if languages <= FEW else by_language


def gram_probabilities(words: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n``, ``p``: number, and the probability of the last character of each gram of the words after the characters before it."""
    _, level = _levels(words)
    found: dict[int, DataFrame] = {}
    languages = level[1].select("lang").distinct().count()
    for order in range(1, ORDER + 1):
        counts = level[order].withColumn("context", F.substring("gram", 1, order - 1))
        times = [F.sum((F.col("n") == i).cast("double")) for i in range(1, 5)]
        off = counts.groupBy("lang").agg(_discount_columns(*times).alias("off"), F.count("gram").alias("symbols"))
        less = F.get("off", F.least(F.col("n"), F.lit(3)).cast("int") - 1)
        cut = counts.join(_sent_if_few(off, languages), "lang").withColumn("cut", F.greatest(F.col("n") - less, F.lit(0.0)))
        totals = cut.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("used"))
        joined = cut.join(totals, ["lang", "context"])
        below = 1 / (F.col("symbols") + 1)
        if order > 1:
            lower = found[order - 1].select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below"))
            joined, below = joined.withColumn("shorter", F.substring("gram", 2, order - 1)).join(lower, ["lang", "shorter"]), F.col("below")
        rest = F.greatest(1 - F.col("used") / F.col("total"), F.lit(1e-9))
        found[order] = written(joined.select("lang", "gram", "n", (F.col("cut") / F.col("total") + rest * below).alias("p")), "probabilities")
    # Below the highest order, words have the grams that begin at their edge.
    return found[ORDER].unionByName(found[3].unionByName(found[2]).where(F.startswith("gram", F.lit(" "))))


def _least_sent(counted: DataFrame, most: int) -> tuple[int, bool]:
    """The least b with at most ``most`` rows whose ``n`` is 2**b or more; whether these are all rows."""
    least, held = 64, 0
    for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().orderBy(F.desc("b")).collect():
        held += r["count"]
        if held > most:
            return least, False
        least = r["b"]
    return least, True


def word_scores(words: DataFrame, texts: DataFrame) -> DataFrame:
    """``key``, ``n``, ``surprise`` and ``excess`` of counted words. ``surprise``: the sum of negative log probabilities of the
    characters and the end; ``excess``: what it is above the language's mean, in the word's best language. ``texts``: ``lang`` and
    its number of texts ``texts``."""
    p = gram_probabilities(words)
    mean = p.groupBy("lang").agg((-F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("mean")).join(texts, "lang")
    mean = written(mean.select("lang", "mean", (F.col("texts") >= ENOUGH).alias("counts")), "means")
    # Partitioned by word, which serves the sums and the languages of a word alike.
    spread = words.withColumn("word_hash", F.xxhash64("word")).repartition("word_hash")
    grams = spread.select("word_hash", "key", "n", (F.length("word") + 1).alias("size"), "lang", F.explode(_grams()).alias("gram"))
    # Most of the words' grams meet a gram that is sent; only the others are moved to theirs.
    least, all_sent = _least_sent(p, SENT_GRAMS)
    power = F.floor(F.log2("n"))
    met = grams.join(F.broadcast(p.where(power >= least).select("lang", "gram", "p")), ["lang", "gram"], "inner" if all_sent else "left")
    if not all_sent:
        rare = p.where(power < least).select("lang", "gram", "p")
        met = met.where("p IS NOT NULL").unionByName(met.where("p IS NULL").drop("p").join(rare, ["lang", "gram"]))
    summed = met.groupBy("word_hash", "key", "n", "size", "lang").agg(F.sum(-F.log("p")).alias("surprise"))
    own = summed.join(_sent_if_few(mean, mean.count()), "lang").withColumn("own", F.col("surprise") - F.col("size") * F.col("mean"))
    best = F.min(F.when(F.col("counts"), F.col("own"))).over(Window.partitionBy("word_hash"))
    return own.select("key", "n", "surprise", F.least("own", best).alias("excess"))


def _hash(lang: int, points: np.ndarray) -> np.ndarray:
    """Hashes of grams given as rows of code points."""
    h = np.full(len(points), lang + 1, "uint64")
    for column in points.T:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column.astype("uint64") + np.uint64(1))
    return h


def _points(grams: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(len(grams), n)


class Model:
    """``shares[k]``, ``rests[k]``: sorted hashes and values for the grams, and the contexts, of order k."""

    def __init__(self, languages: list[str]):
        self.languages = {name: i for i, name in enumerate(languages)}
        self.shares: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.rests: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.symbols = np.ones(len(languages))

    def add(self, order: int, langs: list[str], grams: list[str], share: np.ndarray) -> None:
        """Grams of one order with their discounted shares of their contexts' counts."""
        lang = np.array([self.languages[x] for x in langs], "int64")
        points = _points(grams, order)
        context = _hash(lang, points[:, :-1])
        table = lambda h, v: (np.sort(h), v[np.argsort(h)].astype("float32"))
        self.shares[order] = table(_hash(lang, points), share)
        names, back = np.unique(context, return_inverse=True)
        self.rests[order] = names, (1 - np.bincount(back, weights=share, minlength=len(names))).clip(1e-9, 1).astype("float32")
        if order == 1:
            self.symbols = np.maximum(np.bincount(lang, minlength=len(self.languages)), 1) + 1.0

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, otherwise: float) -> np.ndarray:
        names, values = table
        if not len(names):
            return np.full(len(keys), otherwise)
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        return np.where(names[at] == keys, values[at], otherwise)

    def surprise(self, lang: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of negative log probabilities of each word's characters and end; their number."""
        parts = [self._surprise(lang, words[a : a + WORDS_AT_ONCE]) for a in range(0, len(words), WORDS_AT_ONCE)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0, "int64"))

    def _surprise(self, lang: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number = self.languages.get(lang)
        length = np.array([len(w) + 1 for w in words], "int64")
        if number is None or not words:
            return np.zeros(len(words)), length
        text = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4")
        at = np.arange(1, len(text))
        begin = np.repeat(np.cumsum(length) - length, length)  # the space before each word
        p = np.full(len(at), 1 / self.symbols[number])
        lang_of = np.full(len(at), number)
        for order in range(1, ORDER + 1):
            fits = np.flatnonzero(at - order + 1 >= begin)
            points = text[at[fits][:, None] + np.arange(1 - order, 1)]
            share = self._look(self.shares[order], _hash(lang_of[fits], points), 0.0)
            rest = self._look(self.rests[order], _hash(lang_of[fits], points[:, :-1]), 1.0)
            p[fits] = share + rest * p[fits]
        return np.add.reduceat(-np.log(p), np.cumsum(length) - length), length


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """A model of all words of ``docs`` with at most ``MOST`` n-grams an order, for texts that ``docs`` does not hold. The mass of
    n-grams that it leaves out goes to the next lower order. ``assess`` does not use it."""
    grams, level = _levels(count_words(docs, lang, text))
    languages = sorted(r[0] for r in grams.select("lang").distinct().collect())
    model = Model(languages)
    for order, counts in level.items():
        found = counts.groupBy("lang").agg(F.sum("n").alias("total"), *[F.sum((F.col("n") == i).cast("bigint")).alias(f"n{i}") for i in range(1, 5)]).collect()
        least = max(1, sum(r["total"] for r in found) / MOST)
        totals = counts.groupBy("lang", F.substring("gram", 1, order - 1).alias("context")).agg(F.sum("n").alias("total"))
        kept = counts.where(F.col("n") >= least).withColumn("context", F.substring("gram", 1, order - 1)).join(totals, ["lang", "context"])
        rows = kept.select("lang", "gram", "n", "total").toPandas()
        off = {r["lang"]: _discounts(r["n1"], r["n2"], r["n3"], r["n4"]) for r in found}
        n = rows["n"].to_numpy("float64")
        discounts = np.array([off[x] for x in rows["lang"]]).reshape(len(rows), 3)
        share = np.maximum(n - discounts[np.arange(len(rows)), np.clip(n, 1, 3).astype("int64") - 1], 0) / rows["total"].to_numpy("float64")
        model.add(order, rows["lang"].tolist(), rows["gram"].tolist(), share)
    return model


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and above, by the counts of counts; each within (0, its count)."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratio = lambda a, b: b / a if a else 1.0
    raw = 1 - 2 * y * ratio(n1, n2), 2 - 3 * y * ratio(n2, n3), 3 - 4 * y * ratio(n3, n4)
    return tuple(float(min(max(d, 0.1), i + 0.9)) for i, d in enumerate(raw))


def _discount_columns(n1: Column, n2: Column, n3: Column, n4: Column) -> Column:
    """``_discounts`` as an array column."""
    y = F.when(n1 > 0, n1 / (n1 + 2 * n2)).otherwise(0.5)
    ratio = lambda a, b: F.when(a > 0, b / a).otherwise(1.0)
    raw = 1 - 2 * y * ratio(n1, n2), 2 - 3 * y * ratio(n2, n3), 3 - 4 * y * ratio(n3, n4)
    return F.array(*[F.least(F.greatest(d, F.lit(0.1)), F.lit(i + 0.9)) for i, d in enumerate(raw)])


def frequent(scores: DataFrame, values: list[str]) -> list[np.ndarray]:
    """Keys, in ascending order, and ``values`` of the words with at least 2**b occurrences, for the least b with at most ``SENT`` words."""
    least, _ = _least_sent(scores, SENT)
    power = F.floor(F.log2("n"))
    rows = scores.where(power >= least).select("key", *[F.col(v).cast("float") for v in values]).toArrow()
    key = rows.column("key").to_numpy().view("uint64")
    order = np.argsort(key)
    return [key[order], *(rows.column(v).to_numpy()[order] for v in values)]


def score(docs: DataFrame, scores: DataFrame, lang: str = "lang", text: str = "text", into: str = "quality", drop_text: bool = False) -> DataFrame:
    """``docs`` with a struct ``into`` (a free name): the counted features and the sums of ``VALUES`` of its words that are
    sent to the executors, and ``others``, the keys of its other words. Rows are scored where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(scores, VALUES))
    of_lang, raw_text = free_name(docs, "_lang"), free_name(docs, "_raw")
    plain = docs.withColumns({of_lang: _language(F.col(lang)), raw_text: F.col(text).cast("string").cast("binary")})
    plain = plain.drop(text) if drop_text else plain
    kind = StructType([*(StructField(f, LongType()) for f in FEATURES), *(StructField(v, DoubleType()) for v in VALUES), StructField("others", ArrayType(LongType()))])
    schema = StructType([*plain.schema.fields[:-2], StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *values = shared.value
        for batch in batches:
            texts, langs = batch.column(batch.num_columns - 1).to_pylist(), np.array(batch.column(batch.num_columns - 2).to_pylist(), object)
            for some in grouped(texts):
                words = words_of(texts[some])
                found = features(texts[some], words)
                _, _, keys = _word_keys(words, langs[some])
                keys, back = np.unique(keys, return_inverse=True)
                at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                sent = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[words.first])  # noqa: B023, E731
                sums = [total(np.where(sent, v[at], 0.0)[back] if len(known) else np.zeros(len(back))) for v in values]
                other = ~sent[back]
                first = np.concatenate([[0], np.cumsum(other)])[words.first].astype("int32")
                others = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(keys[back[other]].view("int64"), pa.int64()))
                part = batch.slice(some.start, some.stop - some.start)
                columns = [*(pa.array(found[f], pa.int64()) for f in FEATURES), *(pa.array(x, pa.float64()) for x in sums), others]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.StructArray.from_arrays(columns, names=kind.names)], names=schema.names)

    return plain.mapInArrow(run, schema)


def summed(scored: DataFrame, scores: DataFrame, lang: str, into: str, number: str) -> DataFrame:
    """``number``, ``lang`` and the struct ``into`` of the features, ``log_perplexity`` and ``excess`` (null without words) of rows that ``score`` gives,
    ``number`` telling them apart."""
    others = scored.select(number, F.explode(F.col(into)["others"]).alias("key")).join(scores.select("key", *VALUES), "key")
    others = others.groupBy(F.col(number).alias("_at")).agg(*[F.sum(v).alias(f"_{v}") for v in VALUES])
    value = lambda name: F.col(into)[name]
    joined = scored.select(number, lang, into).join(others, F.col(number) == F.col("_at"), "left")
    symbols = value("word_chars") + value("n_words")  # a word's end counts as one
    mean = lambda v: F.when(symbols > 0, (value(v) + F.coalesce(f"_{v}", F.lit(0.0))) / symbols)
    return joined.select(number, lang, F.struct(*[value(f).alias(f) for f in FEATURES], mean("surprise").alias("log_perplexity"), mean("excess").alias("excess")).alias(into))


def judged(scored: DataFrame, lang: str = "lang", into: str = "quality") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to the struct that ``summed`` gives, without ``excess``; reads ``scored`` twice."""
    value = lambda name: F.col(into)[name]
    failed = (value("n_words") < 50) | (100 * value("n_repeat_words") > 50 * value("n_words"))
    at = F.percentile_approx(value("log_perplexity"), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.lit(10_000))
    bands = scored.where(~failed).groupBy(_language(F.col(lang)).alias("of")).agg(at.alias("q"), F.count(value("log_perplexity")).alias("n"))
    reach = F.greatest(F.lit(LEAST_BAND), F.lit(SPREADS) * (F.col("q")[2] - F.col("q")[0]) / 2.563)
    share = F.least(F.pow(F.col("q")[0] / F.col("q")[1], F.lit(SPREADS / 1.2816)), F.lit(MOST_LOW))
    band = F.struct((F.col("q")[1] * share).alias("low"), (F.col("q")[1] + reach).alias("high"), reach.alias("reach"))
    own, found = free_name(scored, "_of"), free_name(scored, "_band")
    bands = written(bands.where(F.col("n") >= ENOUGH).select(F.col("of").alias(own), band.alias(found)), "bands")
    if bands.count() <= FEW:
        bands = F.broadcast(bands)
    high = (value("log_perplexity") > F.col(found)["high"]) & (value("excess") > F.col(found)["reach"])
    outside = (value("log_perplexity") < F.col(found)["low"]) | high
    joined = scored.join(bands, _language(scored[lang]) == bands[own], "left")
    verdict = F.col(into).dropFields("excess").withField("base_failed", failed).withField("kept", ~failed & ~F.coalesce(outside, F.lit(False)))
    return joined.withColumn(into, verdict).drop(own, found)


def assess(docs: DataFrame, lang: str = "lang", text: str = "text", into: str = "quality", drop_text: bool = False) -> DataFrame:
    """Scores the words of ``docs`` by the model of all of them, writes the texts' sums to the shared folder and judges them."""
    words = written(keyed(count_words(docs, lang, text)), "words")
    texts = docs.groupBy(_language(F.col(lang)).alias("lang")).agg(F.count(F.lit(1)).alias("texts"))
    scores = written(word_scores(words, texts), "scores")
    number = free_name(docs, "_number")
    scored = written(score(docs, scores, lang, text, into, drop_text).withColumn(number, F.monotonically_increasing_id()), "scored")
    totals = written(summed(scored, scores, lang, into, number), "totals")
    verdicts = judged(totals, lang, into).select(number, into)
    return scored.drop(into).join(verdicts, number).drop(number)
