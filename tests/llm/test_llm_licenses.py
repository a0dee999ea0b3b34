import random
import re

import llmdata
import pytest

from layerwright.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base(text):
    words = WORD.findall(lower(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def blocks(text):
    out = [[]]
    for line in lower(text).split("\n"):
        if WORD.search(line):
            out[-1] += WORD.findall(line)
        else:
            out.append([])
    return [b for b in out if b]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def contained(text, templates, per_cent):
    """Every pair of a block and a template, tried one by one."""
    out, number = set(), 0
    for label, some in templates.items():
        for t in some:
            want = shingles([w for b in blocks(t) for w in b])
            for i, b in enumerate(blocks(text)):
                n = len(want & shingles(b))
                if 100 * n >= per_cent * len(want):
                    out.add((i, number, label, round(n / len(want), 9)))
            number += 1
    return out


def check(spark, rows, templates=licenses.TEMPLATES, per_cent=licenses.CONTAINED):
    found = licenses.scan(llmdata.frame(spark, rows), templates=templates, contained=per_cent).collect()
    key = lambda x: repr(x)
    got, want = [], []
    for r in found:
        got.append((r["doc_id"], r["source"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9),
                    sorted((m["block"], m["template"], m["label"], round(m["share"], 9)) for m in r["matches"])))
    for r in rows:
        n, n_base, first, last, labels = base(r[1])
        pairs = contained(r[1], templates, per_cent)
        every = ",".join(sorted({*filter(None, labels.split(",")), *(p[2] for p in pairs)}))
        score = max([p[3] for p in pairs] + [0.5 if n_base else 0.0])
        want.append((r[0], r[3], n, n_base, first, last, labels, every, score, sorted(pairs)))
    assert sorted(got, key=key) == sorted(want, key=key)
    return found


def worn(rng, template, share):
    """A template with some words changed, wrapped as a comment."""
    words = template.split()
    for _ in range(int(share * len(words))):
        words[rng.randrange(len(words))] = rng.choice(["other", "MIT license", "the", "x"])
    lines, at = [], 0
    while at < len(words):
        n = rng.randint(4, 12)
        lines.append(rng.choice(["# ", " * ", "// ", ""]) + " ".join(words[at : at + n]))
        at += n
    return "\n".join(lines)


def texts(seed):
    rng = random.Random(seed)
    every = [t for some in licenses.TEMPLATES.values() for t in some]
    out = ["MIT-License", "the mit\n\nlicense, MIT License mit license", "apache LICENSE\tgeneral-public  license", "mitlicense mit licenses émit license", "mit license" * 3]
    out += ["general public general public license public license", "\n#\n# \n", "mit " * 3000 + "license " * 3000, "Released under the MIT License.", "a. " * 5]
    for _ in range(40):
        some = [worn(rng, rng.choice(every), rng.choice([0, 0.02, 0.05, 0.1, 0.3])) for _ in range(rng.randint(1, 4))]
        out.append(rng.choice(["\n\n", "\n#\n", "\n", " "]).join(some))
    return out + ["\n\n".join(every), " ".join(every), out[-1], out[-1]]


def rows_of(seed):
    rows = llmdata.documents(seed)
    rows += [(1000 + i, t, None, f"s{i}", 0, None, 1) for i, t in enumerate(texts(seed))]
    return [*rows, (None, texts(seed)[8], None, None, None, None, None), (None, texts(seed)[8], None, None, None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    found = check(spark, rows_of(seed))
    assert {m["label"] for r in found for m in r["matches"]} == set(licenses.TEMPLATES)


@pytest.mark.parametrize("per_cent", [1, 40, 100])
def test_other_thresholds(spark, per_cent):
    check(spark, rows_of(3)[-60:], per_cent=per_cent)


def test_templates_that_share_tokens(spark):
    templates = {"a": ("one two three four five six seven",), "b": ("zero one two three four five six", "five five five five five")}
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(["zero one two three four five six seven", "one two three four five", "five " * 9, "x one two three four five six"])]
    check(spark, rows, templates, 60)


def test_nothing_to_find(spark):
    check(spark, [])
    check(spark, llmdata.documents(4), templates={})


def test_a_template_needs_a_token(spark):
    with pytest.raises(ValueError):
        licenses.scan(llmdata.frame(spark), templates={"a": ("too short",)})


def test_other_columns_pass_and_clashing_names_move(spark):
    docs = llmdata.frame(spark).withColumnRenamed("spans", "labels").withColumnRenamed("raw", "_raw")
    found = licenses.scan(docs)
    assert found.columns == ["doc_id", "lang", "source", "batch", "_raw", "labels", "n_words", "n_base", "first_word", "last_word", "base_labels", "_labels", "score", "matches"]
    assert found.count() == docs.count()
