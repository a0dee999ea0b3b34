import collections
import random
import zlib

import llmdata
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from layerwright.llm import packing, words_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
BITS = [" ", "\n", "\t", "\v", "\f", "\r", "\x1c", "\x85", "\u2028", "\u3000", "́", "e", "İ", "Σ", "ς", "ß", "'s", "'LL", "don't", "L'été", "12", "日", "<|endoftext|>", "<|", "\0", "…", "ﬁ", "K", "('tis", "--", "ÿ", "ª"]


def test_ids_like_the_library():
    rng, library = random.Random(5), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 10))) for _ in range(5000)] + [r[1] for r in llmdata.documents()]
    for text, ids in zip(texts, words_bpe.tokenizer(PATH).encode([t and t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_small_tables_of_known_words(monkeypatch):
    monkeypatch.setattr(words_bpe, "KEPT", 2)
    monkeypatch.setattr(words_bpe, "AT_ONCE", 3)
    tokens, library = words_bpe.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for r in llmdata.documents(7, 5):
        assert np.frombuffer(tokens.encode([r[1] and r[1].encode()])[0], "<u4").tolist() == library.encode(r[1] or "", add_special_tokens=False).ids


PLAIN_BITS = ["'", "''", "'s", "'S", "'t", "'re", "'VE", "'ll", "'d", "'m", "'r", "'é", ".", "--", "|", "<", "7", "42", "a", "THE", "ing", "tion", "É", "à", "ÿ", "ß", "×", "÷", "x" * 31, "lorem" * 8, "=" * 33]


class Refusing:
    def __getattr__(self, name):
        raise AssertionError(f"{name} of the library is asked")


def test_plain_words_are_merged_without_the_library():
    rng, tokens, library = random.Random(8), words_bpe.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    letters = "etaoinshrdlucmfwygpbvkxqjzETAOINàéüßÿÖ"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(["", ".", "'s", "'re", "?!", "7"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    tokens.tokenizer = Refusing()
    for text, ids in zip(texts, tokens.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_and_signs_like_the_library():
    rng, library = random.Random(9), Tokenizer.from_file(PATH)
    texts = ["".join(rng.choice([*PLAIN_BITS, " ", rng.choice(BITS)]) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += [rng.choice("abéÉ-'") * n for n in range(1, 70) for _ in range(4)] + ["a'", "'", ""]
    for text, ids in zip(texts, words_bpe.WordTokenizer(PATH).encode([t.encode() for t in texts], at_once=200), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_short_ids(spark):
    docs = llmdata.frame(spark)
    wide, short = ({(r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in packing.token_pieces(docs, PATH, 32, 1, crc=False, short=s).collect()} for s in (False, True))
    assert {(*r[:4], np.frombuffer(r[4], "<u4").astype("<u2").tobytes()) for r in wide} == short
    with pytest.raises(Exception, match="more than 16 bits"):
        packing.token_pieces(docs, PATH, 32, 70_000, crc=False, short=True).collect()


def check_places(rows, size):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("size", [4096, 64])
def test_documents(spark, size):
    rows = llmdata.documents()
    library = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), size):
            part = ids[i : i + size]
            want[r[0], i // size, i, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    packed = packing.pack_documents(llmdata.frame(spark, rows), PATH, size=size).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in packed)
    total = sum(r["length"] for r in packed)
    assert check_places(packed, size) <= -(-total // size) * 1.05 + 1


def test_empty_table_and_clashing_names(spark):
    assert packing.pack_documents(llmdata.frame(spark, []), PATH).count() == 0
    pieces = spark.createDataFrame([(1, 5, 9), (2, 3, 9)], "id int, length int, offset int")
    assert packing.pack(pieces, 8).columns == ["id", "length", "offset", "sequence_id", "_offset"]


def test_bins_are_bounded_and_the_fullest_closes():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(8) == (2, 0)  # closes bin 1, of which three were free
    assert bins.count == 2
    assert bins.place(3) == (0, 6)
    assert bins.place(2) == (2, 8)


def test_random_lengths_fill_well():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 900) for _ in range(5000)), reverse=True)
    bins, used = packing.OpenBins(1000, 5000), collections.Counter()
    for n in lengths:
        at, offset = bins.place(n)
        assert offset == used[at]
        used[at] += n
    assert max(used.values()) <= 1000
    assert len(used) <= sum(lengths) / 1000 * 1.02 + 1
