import random
from collections import defaultdict

from conftest import plan, rows

from layerwright.operators import changes

SCHEMA = "k int, part string, _record_hash string, other int"


def plain(before, after):
    sides = defaultdict(lambda: ([], []))
    for side, some in enumerate((before, after)):
        for k, part, digest, _ in some:
            sides[k, part][side].append(digest)
    kinds = {}
    for key, (old, new) in sides.items():
        kinds[key] = "new" if not old else "gone" if not new else "same" if sorted(old) == sorted(new) else "changed"
    return sorted(((*key, kind) for key, kind in kinds.items()), key=repr)


def deliveries(seed):
    rng = random.Random(seed)
    row = lambda: (rng.choice([None, *range(12)]), rng.choice(["a", "b", None]), f"h{rng.randint(0, 2)}", rng.randint(0, 9))
    return [row() for _ in range(60)], [row() for _ in range(60)]


def test_like_brute_force(spark):
    for seed in range(4):
        before, after = deliveries(seed)
        frames = [spark.createDataFrame(x, SCHEMA) for x in (before, after)]
        found = changes(*frames, ("k", "part"), same=True)
        assert rows(found) == plain(before, after)
        assert rows(changes(*frames, ("k", "part"))) == [r for r in plain(before, after) if r[2] != "same"]


def test_a_crowded_key_is_combined_before_the_shuffle(spark):
    same = spark.range(20_000).selectExpr("1 AS k", "'a' AS part", "'h' AS _record_hash", "0 AS other")
    found = changes(same, same.limit(19_999), ("k", "part"))
    assert "other" not in plan(found) and plan(found).count("Exchange hashpartitioning") == 1
    assert rows(found) == [(1, "a", "changed")]
    assert rows(changes(same, same, ("k", "part"))) == []


def test_empty_deliveries(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "a", "h", 0)], SCHEMA)
    assert rows(changes(none, none, ("k",))) == []
    assert rows(changes(none, one, ("k",))) == [(1, "new")]
    assert rows(changes(one, none, ("k",))) == [(1, "gone")]
