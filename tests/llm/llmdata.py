"""Small tables with the awkward cases: nulls, empty and long texts, repeats, other columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, batch int, raw string, spans int"
SAMPLE = ["the", "cat", "sat", "on", "a", "mat", "and", "then", "it", "ran", "off", "to", "see", "what", "was", "up", "été", "日本", "𝒳y"]


def prose(rng, n):
    return " ".join(rng.choice(SAMPLE) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    passage, base = prose(rng, 50), prose(rng, 120).split(" ")
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(n)]
    texts += [None, "", " \t\n ", "one", "One", "two words", "a  b\nc\td", "x" * 3000, "la " * 400, prose(rng, 20_000)]
    texts += [f"{prose(rng, rng.randint(0, 30))}\n{passage} {prose(rng, rng.randint(0, 30))}" for _ in range(8)]
    texts += [texts[0], texts[0].upper(), texts[1], texts[1], None, passage, passage]
    for _ in range(25):  # copies of one text with some words changed
        copy = list(base)
        for at in rng.sample(range(len(copy)), rng.randint(0, 8)):
            copy[at] = prose(rng, 1)
        texts.append(" ".join(copy))
    rows = [(i, t, rng.choice(["en", "fr", None]), f"s{i % 3}", i, "r", 7) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[3], "en", "s", 1, None, None), (None, None, None, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)
