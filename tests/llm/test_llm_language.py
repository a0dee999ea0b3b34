import llmdata
import numpy as np
import public_tokenizers
import pytest

from layerwright.llm import catalogue, langid

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def plain_forward(word, number, p, size):
    text, sums = langid.SPACE + word, [1.0]
    for end in range(1, len(text) + 1):
        total = 0.0
        for begin in range(end):
            part = text[begin:end]
            if part in number:
                total += sums[begin] * p[number[part]]
            elif end - begin == 1:
                total += sums[begin] * p[size]
        sums.append(total)
    return np.log(sums[-1])


def test_forward_sums_all_segmentations():
    import sentencepiece

    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PATH), langid.vocabulary(PATH)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    plain = sorted({p for p in names if p == "▁" or ((s := p.removeprefix("▁")).isalpha() and s == s.lower())})
    number = {p: i for i, p in enumerate(plain)}
    p = np.random.default_rng(1).random((pieces.size + 1, 2)) * 1e-3
    words = ["the", "ça", "straße", "日本", "aaaaaaaaaaaa", "x", "unbelievable"]
    long = [*words, "the" * 9, "antidis" * 12, "é日" * 17]
    plain = [[plain_forward(w, number, p[:, j], pieces.size) for j in (0, 1)] for w in long]
    assert langid.forward(long, pieces, p) == pytest.approx(np.array(plain))
    endless = langid.forward(["aaaaaaab" * 4000, "the"], pieces, p)
    twice = langid.forward(["aaaaaaab" * 8000], pieces, p)
    assert np.isfinite(endless).all() and twice[0] == pytest.approx(2 * endless[0], rel=1e-3)
    found = langid.forward(words, pieces, p)
    assert found == pytest.approx(np.array([[plain_forward(w, number, p[:, j], pieces.size) for j in (0, 1)] for w in words]))
    # The expected number of a piece is the derivative of the log probability by the piece's own.
    times = np.arange(1.0, len(words) + 1)
    e = langid.expected(words, times, pieces, p[:, 0])
    for piece in ("the", "▁the", "a", "aa"):
        q = p[:, :1].copy()
        q[number[piece]] *= 1 + 1e-6
        slope = ((langid.forward(words, pieces, q) - langid.forward(words, pieces, p[:, :1]))[:, 0] * times).sum() / 1e-6
        assert e[number[piece]] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_held_out_accuracy(spark):
    rows = catalogue.op10_language(spark, SF).collect()
    lang = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and len(held) > 20
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(spark):
    rows = llmdata.documents()
    docs = llmdata.frame(spark, rows).withColumnRenamed("spans", "score")
    model = langid.learn(docs, PATH)
    assert model.languages == ["en", "fr"]
    found = langid.predict(docs, model, PATH)
    assert found.columns == [*docs.columns, "lang_pred", "_score"]
    found = found.collect()
    assert len(found) == len(rows)
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)


def test_sent_words_change_nothing(spark, monkeypatch):
    docs = llmdata.frame(spark)
    found = {}
    for sent in (3, 1 << 18):
        monkeypatch.setattr(langid, "SENT", sent)
        model = langid.learn(docs, PATH)
        assert (len(model.words) == 3) == (sent == 3)
        found[sent] = sorted(map(repr, langid.predict(docs, model, PATH).select("doc_id", "lang_pred", "score").collect()))
    assert found[3] == found[1 << 18]


def test_nothing_learned_and_empty_tables(spark):
    none = llmdata.frame(spark, [])
    model = langid.learn(none, PATH)
    assert langid.predict(none, model, PATH).count() == 0
    assert {r["lang_pred"] for r in langid.predict(llmdata.frame(spark), model, PATH).collect()} == {"und"}
