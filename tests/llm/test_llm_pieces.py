import random

import llmdata
import numpy as np
import public_tokenizers
import sentencepiece

from layerwright.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
BITS = [" ", "  ", "   ", "\n", "\t", "▁", "a", "b", "the", "ing", "é", "日", "𝒳", "0", "12", "<s>", "<0x0A>", "</s>", "\0", "==", "...", "́", "\r", " " * 17, "的"]


def library(text):
    return sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text, add_bos=True, add_eos=True)


def test_like_the_library_on_random_texts():
    rng, known = random.Random(4), sentencepiece.SentencePieceProcessor(model_file=PATH)
    model = pieces.model(PATH)
    some = list(model.ids)
    for _ in range(5000):
        text = "".join(rng.choice(BITS) if rng.random() < 0.6 else rng.choice(some) for _ in range(rng.randint(0, 12)))
        want = known.encode(text, add_bos=True, add_eos=True)
        ids = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert model.decode(ids) == known.decode(want), text


def test_small_tables_of_known_words(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 3)
    model = pieces.PieceModel(PATH)
    text = "now and then a word, and then some more words and then none"
    assert np.frombuffer(model.encode(text), "<u4").tolist() == library(text)


def test_frame(spark):
    rows = llmdata.documents()
    docs = llmdata.frame(spark, rows).withColumnRenamed("raw", "ids")
    coded = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert coded.columns == [*docs.columns, "decoded"]
    known = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in coded.collect():
        want = known.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want
        assert r["decoded"] == known.decode(want)


def test_empty_table_and_null_ids(spark):
    assert pieces.encode(llmdata.frame(spark, []), PATH).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).first()["decoded"] == ""
