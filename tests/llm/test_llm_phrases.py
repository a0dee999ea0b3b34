import collections
import random
import re

import llmdata
import pytest

from layerwright.llm import phrases

ENDS, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")


def plain(rows, least, top, inside=50):
    """The contract, counted one by one."""
    n, times = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in ENDS.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = WORD.findall(piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                times.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = collections.defaultdict(list)
    for (lang, words), a in times.items():
        if len(words) == 1 or a < least:
            continue
        score, _, left, right = min(
            (1000000 * a * a // (x * y), k, x, y) for k in range(1, len(words)) for x, y in [(times[lang, words[:k]], times[lang, words[k:]])]
        )
        longer = [b for (other, more), b in times.items() if other == lang and len(words) == 2 and len(more) == 3 and b >= least and words in (more[:2], more[1:])]
        if not any(100 * b >= inside * a for b in longer):
            found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, some in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(some)[:top], 1)
    }


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, rank int").repartition(4)
    got = phrases.collocations(docs, **options).collect()
    assert len({tuple(r) for r in got}) == len(got)
    return {tuple(r) for r in got}


def awkward(seed):
    rng = random.Random(seed)
    rows = [(r[2], r[1]) for r in llmdata.documents(seed)]
    rows += [("en", "New York, new york! NEW\tYORK  new york;new york:\x0bnew york\r\nnew york" * 3), ("en", "é É e e \x1c x"), (None, ".,;:!?\n\n ")]
    rows += [(rng.choice(["en", "fr", None]), "one two three four five six seven " * rng.randint(1, 40)) for _ in range(6)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = awkward(seed)
    got = mined(spark, rows, least=10, top=50)
    assert got == plain(rows, 10, 50) and len(got) > 50


def test_small_batches_blocks_and_chunks(spark, monkeypatch):
    for name, value in (("BATCH_BYTES", 3000), ("BLOCK_BYTES", 5000), ("EVERY", 2), ("CHUNK_WORDS", 5)):
        monkeypatch.setattr(phrases, name, value)
    rows = awkward(3)
    assert mined(spark, rows, least=3, top=10**6) == plain(rows, 3, 10**6)


def test_crowded_parts(spark, monkeypatch):
    monkeypatch.setattr("layerwright.llm.hot.SHARE", 0.05)
    rows = [("en", " . ".join(f"the w{i} the w{i}" for i in range(200) for _ in range(5)))] * 2
    assert mined(spark, rows, least=10, top=10**6) == plain(rows, 10, 10**6)


def test_chunks_own_each_word_once():
    rng = random.Random(1)
    for n in (1, 2, 3, 64, 65, 66, 67, 500):
        words = [rng.choice([b"a", b"bb", b"ccc", b"dd", b"e"]) for _ in range(n)]
        parts, at = list(phrases.chunks(words, phrases._Triggers())), 0
        for chunk in parts:
            ahead = len(chunk) - len(chunk.rstrip(b" "))
            own = len(chunk.split()) - ahead
            assert chunk.split() == words[at : at + own + 2] and ahead == min(2, n - at - own)
            at += own
        assert at == n


def test_nothing_to_count(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(None, None), ("en", ""), ("en", "a b c")]) == set()


def test_one_long_piece(spark):
    rows = [("en", " ".join(["ab cd"] * 30000) + " . " + "ab . cd . " * 10)] * 3
    assert mined(spark, rows, least=10) == plain(rows, 10, 2000)
