import collections
import fnmatch
import os

import llmdata
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from layerwright.llm import ordering

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 4096, 4097, 70001])
def test_slots_are_a_permutation(n):
    one, two = (ordering.permuted(np.arange(n), n, key) for key in (1, 2))
    assert sorted(one.tolist()) == sorted(two.tolist()) == list(range(n))
    assert n < 100 or (one != two).any()


def test_order_looks_random():
    n = 70001
    slots = ordering.permuted(np.arange(n), n, 5)
    assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.02
    assert abs((np.diff(slots) > 0).mean() - 0.5) < 0.02


def test_round_trip(spark):
    rows, library = llmdata.documents(), Tokenizer.from_file(PATH)
    folder, n = ordering.materialise(llmdata.frame(spark, rows), PATH, length=32, shard_rows=100)
    found = ordering.read_shards(spark, folder, length=32, shard_rows=100).collect()
    assert sorted(r["slot"] for r in found) == list(range(n))
    assert all(r["slot"] == r["shard"] * 100 + r["place"] for r in found)
    want = collections.Counter()
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 32):
            want[-1 if r[0] is None else r[0], i // 32, tuple(ids[i : i + 32])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in found) == want
    rest = ordering.read_shards(spark, folder, length=32, shard_rows=100, first=n - 150).collect()
    assert sorted(r["slot"] for r in rest) == list(range(n - 150, n))


def test_reading_goes_on_where_earlier_files_are_gone(spark):
    folder, n = ordering.materialise(llmdata.frame(spark), PATH, length=32, shard_rows=40)
    whole = {r["slot"]: tuple(r) for r in ordering.read_shards(spark, folder, length=32, shard_rows=40).collect()}
    assert n > 12 * 40
    for first in (41, 400, 477, n - 1):
        for name in os.listdir(folder):
            if name.startswith("part-") and int(name.split("-")[1]) < first // 40:
                os.remove(f"{folder}/{name}")
        rest = ordering.read_shards(spark, folder, length=32, shard_rows=40, first=first).collect()
        assert {r["slot"]: tuple(r) for r in rest} == {s: r for s, r in whole.items() if s >= first}
    assert not os.path.exists(os.path.join(os.path.dirname(folder), "sequences"))


@pytest.mark.parametrize("shard", [0, 7, 99, 12345, 99999, 100000, 123456, 999999])
def test_names_of_later_files(shard):
    braces = ordering.names_from(shard).removeprefix("part-{").removesuffix("}-*").split(",")
    for number in {0, 1, 6, 7, 8, 98, 99, 100, 999, 12344, 12345, 12346, 99998, 99999, 100000, 123455, 123456, 999998, 999999, 10**6, 10**9}:
        assert any(fnmatch.fnmatchcase(f"{number:05}", p) for p in braces) == (number >= shard)


def test_slots_of_given_sequences(spark):
    """The network written out once more, number by number."""
    n, key = 1000, 7
    for number in (0, 1, 2, 500, 999):
        x = number
        while True:
            left, right = divmod(x, 32)
            for i in range(4):
                k = (key * 1103515245 + (i + 1) * 1664525003) % 2147483647
                f = (right * 1103515245 + k) % 2147483647
                f = ((f ^ (f >> 15)) * 1664525003 + k) % 2147483647
                left, right = right, left ^ ((f ^ (f >> 13)) & 31)
            x = left * 32 + right
            if x < n:
                break
        assert ordering.permuted(np.array([number]), n, key)[0] == x


def test_files_have_one_stride(spark):
    folder, n = ordering.materialise(llmdata.frame(spark), PATH, length=32, shard_rows=100)
    sizes = sorted(r["length"] for r in spark.read.format("binaryFile").load(folder).select("length").collect())
    assert sum(sizes) == n * ordering.stride(32)
    assert set(sizes[1:]) == {100 * ordering.stride(32)}


def test_lots_are_compressed_against_common_ids():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 49_000, 6).astype("<u2").tobytes() for _ in range(500)]
    text = lambda n: b"".join(words[i] for i in rng.integers(0, 500, n))
    lots, common = [text(100) for _ in range(20)], text(20_000)
    (pack, unpack), (alone, restored) = ordering.codec(common), ordering.codec(b"")
    assert [unpack(pack(lot)) for lot in lots] == [restored(alone(lot)) for lot in lots] == lots
    assert 2 * sum(len(pack(lot)) for lot in lots) < sum(len(alone(lot)) for lot in lots)
    for tiny in (b"\1", b"\1\0", b"\1\0" * 5):
        pack, unpack = ordering.codec(tiny)
        assert unpack(pack(lots[0])) == lots[0] and unpack(pack(b"")) == b""


def test_empty_table(spark):
    folder, n = ordering.materialise(llmdata.frame(spark, []), PATH)
    assert n == 0 and ordering.read_shards(spark, folder).count() == 0
