import collections
import os
from concurrent.futures import ThreadPoolExecutor

import brute
import llmdata
import pytest

import corpus_pipeline
from layerwright.llm import catalogue
from layerwright.sources import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's result, the documents first."""
    root = tmp_path_factory.mktemp("stages")
    rows = [(r[0], f"{r[1]} write to a{i}@b.de now" if r[1] and i % 5 == 0 else r[1], *r[2:]) for i, r in enumerate(llmdata.documents(3, 80))]
    docs = llmdata.frame(spark, rows).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")
    docs.write.parquet(f"{root}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, spark.read.parquet(f"{root}/documents.parquet" if len(out) == 1 else f"{root}/{len(out) - 1}"), str(root)).write.parquet(f"{root}/{len(out)}")
        out.append(spark.read.parquet(f"{root}/{len(out)}"))
    return [(df.columns, df.collect()) for df in out], str(root)


def test_columns(stages):
    assert all(columns == COLUMNS for columns, _ in stages[0][:-1])
    assert stages[0][-1][0] == ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]


def test_quality(stages):
    (_, docs), (_, kept) = stages[0][:2]
    failed = lambda f: f[0] < 50 or 100 * f[4] > 50 * f[0]
    want = [r for r in docs if not failed(brute.features(r["text"]))]
    lost = collections.Counter(want) - collections.Counter(kept)
    assert not collections.Counter(kept) - collections.Counter(want)
    assert all(r["text"].isupper() for r in lost)  # the only text here that is far from its language


def test_one_of_each_group(stages):
    (_, docs), (_, kept) = stages[0][1:3]
    assert not collections.Counter(kept) - collections.Counter(docs)
    component = {r: c for r, (_, _, c) in zip(docs, brute.components([(r["doc_id"], r["text"]) for r in docs]), strict=True)}
    assert sorted(map(repr, (component[r] for r in kept))) == sorted(map(repr, set(component.values())))


def test_passages_and_personal_data(stages):
    (_, docs), (_, cut), (_, marked) = stages[0][2:5]
    gone = brute.removed([r["text"] for r in docs], corpus_pipeline.WINDOW)
    want = collections.Counter()
    for r, g in zip(docs, gone, strict=True):
        text = " ".join(w for w, x in zip(brute.words(r["text"]), g, strict=True) if not x) if any(g) else r["text"]
        want[r["doc_id"], text, r["lang"], r["source"], len(text)] += 1
    assert collections.Counter(map(tuple, cut)) == want
    assert any(any(g) for g in gone)
    assert collections.Counter((r["doc_id"], r["source"]) for r in marked) == collections.Counter((r["doc_id"], r["source"]) for r in cut)
    assert any("[EMAIL]" in r["text"] for r in marked) and not any(brute.personal(r["text"]) for r in marked)
    assert all(r["n_chars"] == len(r["text"]) for r in marked)


def test_run_gives_the_last_stage(spark, stages):
    whole, last = corpus_pipeline.run(spark, stages[1]), stages[0][-1][1]
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert collections.Counter(map(key, whole.collect())) == collections.Counter(map(key, last))


def test_every_operator_has_one_query():
    numbers = [int(n.removeprefix("op").split("_")[0]) for n in catalogue.QUERIES]
    assert sorted(numbers) == list(range(1, 14))


def test_results_and_threads_keep_their_tables(spark, tmp_path):
    """A stage that runs again leaves the tables of its first result; pipelines of two threads do not meet."""
    one, two = (llmdata.frame(spark, llmdata.documents(seed)) for seed in (1, 2))
    first = corpus_pipeline.near_duplicates(spark, one, "folder")
    second = corpus_pipeline.near_duplicates(spark, two, "folder")
    n = first.count()
    assert second.count() and first.count() == n
    for seed in (1, 2):
        llmdata.frame(spark, llmdata.documents(seed)).drop("batch", "raw", "spans").write.parquet(f"{tmp_path}/{seed}/documents.parquet")
    counts = [corpus_pipeline.run(spark, f"{tmp_path}/{seed}").count() for seed in (1, 2)]
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(lambda seed: corpus_pipeline.run(spark, f"{tmp_path}/{seed}").count(), (1, 2))) == counts


def test_what_the_result_does_not_read_is_removed(spark, tmp_path):
    llmdata.frame(spark).drop("batch", "raw", "spans").write.parquet(f"{tmp_path}/documents.parquet")
    root = shared_folder(spark)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    result = corpus_pipeline.run(spark, str(tmp_path))
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before}
    assert left <= {"personal-data", "pieces"} and result.count()
