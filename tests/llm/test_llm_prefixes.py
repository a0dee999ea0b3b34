import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from layerwright.llm import prefixes

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int"


def ordered(rows):
    """The turns of each conversation."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, role, tie, text))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in convs.items()}


def begun(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    """The nodes by walking a trie of lists."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, some in members.items():
        below = [n for n in members if n[: len(node)] == node]
        parents = {n[:-1] for n in members if n}
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in some if len(convs[c]) == len(node)))
        children = sum(len(n) == len(node) + 1 for n in below)
        out.add((
            min(some), len(node), min(members[node[:-1]]) if node else None, len(some), children,
            sum(n not in parents for n in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def made(spark, rows, beginnings=True):
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(4)
    turns = prefixes.turns_of(frame)
    if beginnings:
        conv = F.col("conv_id")
        turns = prefixes.with_beginnings(turns, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    found = [tuple(r) for r in prefixes.trie(turns).collect()]
    assert len(found) == len(set(found))
    return set(found)


def conversations(seed, n=60, longest=12, kinds=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", f"t{t} " + "a b " * rng.randint(0, kinds)))
    return rows


AWKWARD = [
    (0, None, None, None), (0, None, "user", ""), (0, 1, "user", "x y"), (0, 1, "user", "x y"), (0, 1, "user", "x z"), (0, 2, "", " \t"),
    (1, 5, "user", "x y"), (2, 5, None, "x y"), (20, 0, "a", "long " * 50_000), (21, 0, "a", "long " * 50_000), (23, 0, "ab", "c"), (24, 0, "a", "bc"),
    (None, 0, "user", "lost"), (None, None, None, None), (60, 0, "s", "only"), (61, 0, "s", "only"), (62, 0, "s", "only"), (63, 1, "s", "only"), (-5, 0, "s", "é \x1c"),
]


@pytest.mark.parametrize("seed,longest,kinds", [(1, 12, 1), (2, 5, 3), (3, 40, 0)])
def test_like_brute_force(spark, seed, longest, kinds):
    rows = conversations(seed, 60 if longest < 40 else 12, longest, kinds)
    assert made(spark, rows) == plain(begun(ordered(rows)))
    assert made(spark, rows, beginnings=False) == plain(ordered(rows))


def test_awkward_rows(spark):
    found = made(spark, AWKWARD)
    assert found == plain(begun(ordered(AWKWARD)))
    assert made(spark, AWKWARD, beginnings=False) == plain(ordered(AWKWARD))


def test_only_conversations_without_turns(spark):
    # Conversations of one turn whose beginning is taken from one that is not there.
    rows = [(c, 0, "user", "hi") for c in range(100, 160) if c % 20 and zlib.crc32(str(c).encode()) % 4]
    assert {r[1] for r in made(spark, rows)} == {0}
    assert made(spark, rows) == plain(begun(ordered(rows)))


def test_crowded_nodes_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr("layerwright.llm.hot.SHARE", 0.02)
    monkeypatch.setattr(prefixes, "IDS", 7)
    monkeypatch.setattr(prefixes, "ROWS", 5)
    rows = conversations(5, 30) + [(1000 + c, t, "user", f"t{t} same") for c in range(150) for t in range(6)]
    rows += [(2000 + c, t, "user", f"t{t} same" if t < 5 else f"own {c}") for c in range(100) for t in range(7)]
    assert made(spark, rows, beginnings=False) == plain(ordered(rows))


def test_no_conversations(spark):
    assert made(spark, []) == set()
    assert made(spark, [(None, 1, "user", "x")]) == set()
