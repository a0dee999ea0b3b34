import collections
import itertools

import brute
import llmdata
import pytest

from layerwright.llm import exchange, substring


def check(spark, rows, size):
    docs = llmdata.frame(spark, rows)
    found = collections.Counter((r["doc_id"], r["source"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedup(docs, size=size).collect())
    want = collections.Counter()
    for r, gone in zip(rows, brute.removed([r[1] for r in rows], size), strict=True):
        kept = itertools.compress(brute.words(r[1]), [not g for g in gone])
        want[r[0], r[3], len(gone), sum(gone), " ".join(kept)] += 1
    assert found == want


@pytest.mark.parametrize("size", [35, 5])
def test_like_brute_force(spark, size):
    check(spark, llmdata.documents(), size)


def test_many_small_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(exchange, "BATCH_BYTES", 4000)
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 9000)
    check(spark, llmdata.documents(2), 35)


def test_window_of_one_word_and_periodic_text(spark):
    rows = [(1, "a b a", None, None, None, None, None), (2, "c " * 90, None, None, None, None, None), (3, "a b c d " * 30, None, None, None, None, None)]
    check(spark, rows, 1)
    check(spark, rows, 35)


def test_empty_table(spark):
    check(spark, [], 35)


def test_factors_are_copies(spark):
    rows = llmdata.documents(3)
    size = 35
    for r in substring.dedup(llmdata.frame(spark, rows), size=size, keep_text=True).collect():
        words = brute.words(r["text"])
        covered = set()
        for f in r["factors"]:
            assert f["length"] >= size and f["start"] + f["length"] <= len(words)
            covered |= set(range(f["start"], f["start"] + f["length"]))
        assert len(covered) == r["n_removed"]


def test_other_columns_pass_and_clashing_names_move(spark):
    docs = llmdata.frame(spark).withColumnRenamed("spans", "n_words")
    found = substring.dedup(docs)
    assert found.columns == ["doc_id", "lang", "source", "batch", "raw", "n_words", "_n_words", "n_removed", "kept", "factors"]
    assert found.count() == docs.count()
