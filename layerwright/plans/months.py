"""Marts over all months, to which each month adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from layerwright.literacy import MART_RULES
from layerwright.operators.lineage import GOLD_TIME, SILVER_PARTITION, RunStamp
from layerwright.operators.quality import counters
from layerwright.plans import marts
from layerwright.plans.runs import Layout, TableRun, _attempt, _check, _month, _stop_on
from layerwright.sources.layers import read_partition, write_partitioned
from layerwright.sources.versions import publish, run_folder
from layerwright.sources.workspace import Staged, file_system, stage, staging

SUMS = "_sums"
STUDENTS = "fct_avaliacao_aluno"
#: Marts of the student fact whose groups add up: what is kept of a month, and the mart of any months' rows of it.
ADDING_UP = {
    "distribuicao_niveis": (marts.level_sums, marts.levels_of),
    "estatisticas_escolares": (marts.school_sums, marts.schools_of),
}


def _other_months(spark: SparkSession, root: str, month: dict[str, int], none: DataFrame) -> DataFrame:
    """What earlier runs have kept of all months but this one."""
    place, files = file_system(spark, root)
    if not files.exists(place):
        return none.limit(0)
    kept = spark.read.schema(StructType([*none.schema.fields, *(StructField(c, IntegerType()) for c in month)])).parquet(root)
    this = F.lit(True)
    for column, value in month.items():
        this = this & (F.col(column) == value)
    return kept.where(~this).drop(*month)


def add_month(spark: SparkSession, layout: Layout, stamp: RunStamp) -> list[TableRun]:
    """Let a month's students count in the marts over all months, beside those of the months added before.

    Of the silver fact only this month is read. A row per group and month is kept in ``_sums`` of the gold layer; the marts are made
    of these. A month that is added again replaces what it gave before. Marts are checked before anything is written, then all of
    them change at once; a run that breaks off between is put right by adding the month again. Students count once a month, so a
    month's delivery must hold what is new: where each one holds everything, ``run_gold`` is the right run, which takes its month alone.
    """
    month = _month(stamp, SILVER_PARTITION)
    with staging(spark), run_folder(spark, layout.gold) as folder:
        read, failed = _attempt("silver", lambda n: read_partition(spark, f"{layout.silver}/{n}", **month), (STUDENTS,))
        _stop_on(failed, "silver", (STUDENTS,))

        def prepare(name: str) -> tuple[Staged, Staged]:
            keep, mart_of = ADDING_UP[name]
            new = stage(keep(read[STUDENTS]), f"{name}-sums")
            df = mart_of(_other_months(spark, f"{layout.gold}/{SUMS}/{name}", month, new.df).unionByName(new.df))
            return new, stage(df, name, counters(df, MART_RULES[name]))

        made, failed = _attempt("gold", prepare, ADDING_UP)
        _stop_on(failed, "gold", ADDING_UP)
        _check("gold", {n: mart for n, (_, mart) in made.items()}, MART_RULES)

        def write(name: str) -> TableRun:
            new, mart = made[name]
            stamped = mart.df.withColumn(GOLD_TIME, stamp.timestamp())
            found = write_partitioned(stamped, f"{folder}/{name}", ("ano",), keep_others=False, gather=True)
            placed = "/".join(f"{c}={v}" for c, v in month.items())
            new.df.write.mode("overwrite").parquet(f"{layout.gold}/{SUMS}/{name}/{placed}")
            return TableRun("gold", name, "written", found["rows"])

        written, failed = _attempt("gold", write, made)
        _stop_on(failed, "gold", made, list(written.values()))
        publish(spark, folder)
    return list(written.values())
