"""Cleans a corpus in stages: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes the documents that the stage before it left and returns the documents it leaves, with the columns of
``documents``; the last returns token pieces with their places in sequences. A stage's decisions take effect in its
result. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerwright.llm import catalogue, jaccard, packing, perplexity, pii, substring
from layerwright.llm.shared import free_name, noting, remove_unused, workers_ready, written

#: Words of a window that may occur only once in the corpus.
WINDOW = 35
#: Tokens of a sequence.
SEQUENCE = 4096

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that stages have written on their way to a result, by thread and folder of the tables, and by stage. The stages that a thread calls on a
#: folder are one pipeline: what a stage has written goes when a later one begins, which reads that stage's result from where it was written.
#: A stage called again, another folder and another thread leave them alone.
_ON_THE_WAY: dict[tuple[int, str], dict[int, list[str]]] = {}


def _on_the_way(sf_dir: str, number: int) -> list[str]:
    return _ON_THE_WAY.setdefault((threading.get_ident(), sf_dir), {}).setdefault(number, [])


def stage(number: int) -> Callable[[Stage], Stage]:
    """The pipeline's stage of that number, whose tables on the way are noted."""

    def decorate(run: Stage) -> Stage:
        @wraps(run)
        def ready(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            workers_ready(spark)
            for earlier in range(number):
                remove_unused(spark, _on_the_way(sf_dir, earlier), docs)
            with noting(_on_the_way(sf_dir, number)):
                return run(spark, docs, sf_dir)

        return ready

    return decorate


def with_text(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """``columns`` of ``docs`` with another text, and its length where a column ``n_chars`` says it."""
    changed = ~text.eqNullSafe(F.col("text"))
    new = {"text": text}
    if "n_chars" in columns:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, length).otherwise(F.col("n_chars"))
    return docs.withColumns(new).select(*columns)


@stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the perplexity bands keep."""
    into = free_name(docs, "quality")
    return perplexity.assess(docs, into=into).where(F.col(into)["kept"]).select(*docs.columns)


@stage(1)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.distinct_documents(docs)


@stage(2)
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated passages cover; texts that lose none stay as they are, line breaks included."""
    removed, kept = free_name(docs, "n_removed"), free_name(docs, "kept")
    parsed = substring.dedup(docs, size=WINDOW, keep_text=True)
    return with_text(parsed, docs.columns, F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text")))


@stage(3)
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    original = free_name(docs, "original")
    marked = pii.redact(docs.withColumn(original, F.col("text")), "text")
    changed = ~F.col("text").eqNullSafe(F.col(original))
    if "n_chars" not in docs.columns:
        return marked.select(*docs.columns)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return marked.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars"))).select(*docs.columns)


@stage(4)
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return packing.pack_documents(docs, catalogue.WORD_VOCABULARY, size=SEQUENCE)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: Tokenisation and the parity-sketch join cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written to the shared folder and read back for the next.

    Tables that what follows does not read are removed as soon as it is written; those that the result reads stay.
    """
    docs, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for number, (name, step) in enumerate(STAGES[:-1]):
        result = step(spark, docs, sf_dir)
        with noting(results):
            docs = written(result, name.replace(" ", "-"))
        remove_unused(spark, _on_the_way(sf_dir, number), docs)
        remove_unused(spark, results, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
