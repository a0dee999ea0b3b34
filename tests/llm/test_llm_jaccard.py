import collections

import brute
import llmdata
import numpy as np
import pytest

from layerwright.llm import exchange, jaccard


def found(docs, **options):
    return collections.Counter((r["row"]["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, **options).collect())


def test_like_brute_force(spark):
    rows = llmdata.documents()
    assert found(llmdata.frame(spark, rows)) == collections.Counter(brute.components([r[:2] for r in rows]))


def test_tiles_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(exchange, "BATCH_BYTES", 5000)
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 9000)
    rows = llmdata.documents(5)
    assert found(llmdata.frame(spark, rows), tile=4) == collections.Counter(brute.components([r[:2] for r in rows]))


def test_empty_table(spark):
    assert not found(llmdata.frame(spark, []))


def test_one_document_of_each_group_stays(spark):
    rows = llmdata.documents()
    kept = jaccard.distinct_documents(llmdata.frame(spark, rows)).collect()
    assert set(map(tuple, kept)) <= set(rows)
    groups = brute.components([r[:2] for r in rows])
    of = collections.defaultdict(set)
    for r, (_, size, component) in zip(rows, groups, strict=True):
        of[r[1]].add((component, size))
    filled = [next(iter(of[r["text"]]))[0] for r in kept if brute.shingles(r["text"])]
    assert sorted(map(repr, filled)) == sorted({repr(c) for _, size, c in groups if size})
    assert sum(not brute.shingles(r["text"]) for r in kept) == sum(not size for _, size, _ in groups)


@pytest.mark.parametrize("n", [30, 90, 128, 129, 200, 700])
def test_sketches_bound_the_difference_and_linked_sets_share_keys(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        a = np.sort(rng.integers(0, 1 << 63, n, dtype="uint64"))
        fresh = rng.integers(0, 1 << 63, n, dtype="uint64")
        swap = n // 7  # differ in 2 * swap shingles: on the bound
        b = np.sort(np.concatenate([a[swap:], fresh[:swap]]))
        differing = len(np.setxor1d(a, b))
        assert 7 * differing <= len(a) + len(b)
        band = int(jaccard.band_of(np.array([n]))[0])
        bits = np.bitwise_count(jaccard.sketch(a, band) ^ jaccard.sketch(b, band)).sum()
        assert bits <= differing
        tokens, first = np.concatenate([a, b]), np.array([0, n, n + len(b)])
        owner, _, key = jaccard.keys_of(tokens, first)
        assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_bands_meet():
    sizes = np.arange(1, 5000)
    largest = sizes * 4 // 3
    assert (jaccard.band_of(largest) <= jaccard.band_of(sizes) + 1).all()
