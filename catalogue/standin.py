"""The seven landing entities, derived from the benchmark tables.

A supplier stands for a school, a nation for a municipality, a region for a state. Ids are bigint:
order keys outgrow 32 bits at scale.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerwright.literacy import BAND_EDGES, LEVELS, TARGET_YEARS, entities
from layerwright.functions import band
from layerwright.jobs import side_by_side
from layerwright.operators import conform, dedup_by_key, lookup_join
from layerwright.sources import stage

PACK = entities(id_type="bigint")
LITERATE_FROM = 743
OWN_ROWS = ("avaliacao_aluno", "mapeamento_municipio")
UNKNOWN_PLACE = 999


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One student per order line."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    )
    schools = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("id_municipio")
    )
    present = F.col("l_returnflag") != "R"
    score = F.when(present, 600 + F.col("l_quantity") * 5)
    return lookup_join(lines, schools, "l_suppkey", how="inner").select(
        (F.year("l_shipdate") + 29).alias("ano"),
        "id_municipio",
        F.col("l_suppkey").alias("id_escola"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id_aluno"),
        F.col("l_linenumber").alias("caderno"),
        F.lit(2).alias("serie"),
        (F.col("l_linenumber") % 5).alias("rede"),
        present.cast("int").alias("presenca"),
        (F.col("l_linestatus") == "F").cast("int").alias("preenchimento_caderno"),
        F.coalesce(score >= LITERATE_FROM, F.lit(False)).cast("int").alias("alfabetizado"),
        score.alias("proficiencia"),
        (1 + F.col("l_tax")).alias("peso_aluno"),
    )


def raw_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Municipality names and states, padded; nation 24 gets an id that no school has, so its schools go unmatched."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(
        F.when(F.col("n_nationkey") == 24, F.lit(UNKNOWN_PLACE)).otherwise(F.col("n_nationkey")).cast("bigint").alias("id_municipio"),
        F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("nome_municipio"),
        _state_code().alias("sigla_uf"),
    )


def _state_code():
    return F.concat(F.lit("  "), F.lower(F.left("r_name", F.lit(2))), F.lit(" "))


SUMS = ("students", "present", "literate", "score", *(f"level_{n}" for n in LEVELS))


@dataclass(frozen=True)
class Areas:
    """Indicators and targets of municipalities, states and the country.

    One pass over the students gives sums per year, municipality and network; these are staged,
    and every other level adds them up.
    """

    spark: SparkSession
    sf_dir: str
    students: DataFrame

    @cached_property
    def base(self) -> DataFrame:
        present = F.col("presenca") == 1
        level = band(F.col("proficiencia"), BAND_EDGES)
        sums = self.students.groupBy("ano", "id_municipio", "rede").agg(
            F.count(F.lit(1)).alias("students"),
            F.count_if(present).alias("present"),
            F.sum("alfabetizado").alias("literate"),
            F.sum("proficiencia").alias("score"),
            *(F.count_if(present & (level == n)).alias(f"level_{n}") for n in LEVELS),
        )
        return stage(sums, "area-sums").df

    @cached_property
    def states(self) -> DataFrame:
        nations = table(self.spark, self.sf_dir, "nation")
        regions = table(self.spark, self.sf_dir, "region")
        return nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(
            F.col("n_nationkey").cast("bigint").alias("id_municipio"),
            "r_regionkey",
            _state_code().alias("sigla_uf"),
        )

    @cached_property
    def base_by_state(self) -> DataFrame:
        return self.base.join(self.states, "id_municipio")

    def _sums(self, df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS))

    def _indicators(self, df: DataFrame, *keys: str) -> DataFrame:
        return df.select(
            *keys,
            F.lit(2).alias("serie"),
            _rate("literate", "students").alias("taxa_alfabetizacao"),
            F.try_divide("score", "present").alias("media_portugues"),
            *(_rate(f"level_{n}", "present").alias(f"proporcao_aluno_nivel_{n}") for n in LEVELS),
        )

    def _targets(self, df: DataFrame, offset, *keys: str) -> DataFrame:
        return df.select(
            *keys,
            F.lit(" PUBLICA ").alias("rede"),
            _rate("literate", "students").alias("taxa_alfabetizacao"),
            _rate("present", "students").alias("percentual_participacao"),
            *(
                (40.0 + offset + 5 * (y - 2024)).alias(f"meta_alfabetizacao_{y}")
                for y in TARGET_YEARS
            ),
        )

    def raw(self, entity: str) -> DataFrame:
        """Raw rows of one of the five aggregated entities."""
        if entity == "municipio":
            return self._indicators(self.base, "ano", "id_municipio", "rede")
        if entity == "uf":
            by_state = self._sums(self.base_by_state, "ano", "sigla_uf", "rede")
            return self._indicators(by_state, "ano", "sigla_uf", "rede")
        if entity == "meta_brasil":
            return self._targets(self._sums(self.base, "ano"), F.lit(0), "ano")
        if entity == "meta_municipio":
            level = F.nullif(F.col("id_municipio") % 9, F.lit(8)).cast("int")
            by_town = self._sums(self.base, "ano", "id_municipio").withColumn("nivel_alfabetizacao", level)
            return self._targets(
                by_town, F.col("id_municipio"), "ano", "id_municipio", "nivel_alfabetizacao"
            )
        by_state = self._sums(self.base_by_state, "ano", "sigla_uf", "r_regionkey")
        return self._targets(by_state, F.col("r_regionkey"), "ano", "sigla_uf")


def _rate(part: str, whole: str):
    return F.try_divide(100.0 * F.col(part), F.col(whole))


def raw_entities(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Raw rows of the entities named, or of all seven."""
    students = raw_students(spark, sf_dir)
    areas = Areas(spark, sf_dir, students)
    own = {"avaliacao_aluno": lambda: students, "mapeamento_municipio": lambda: raw_map(spark, sf_dir)}
    return {n: own[n]() if n in own else areas.raw(n) for n in names or PACK}


def conformed(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Conformed entities, students without duplicate keys; the other entities have none.

    Students' duplicates and the areas' sums come from one pass each, run side by side.
    """
    raw_student = raw_students(spark, sf_dir)
    areas = Areas(spark, sf_dir, raw_student)

    def several(group: str) -> dict[str, DataFrame]:
        if group == "areas":
            return {n: conform(areas.raw(n), PACK[n]) for n in names if n not in OWN_ROWS}
        found = {}
        if "avaliacao_aluno" in names:
            entity = PACK["avaliacao_aluno"]
            found[entity.name] = dedup_by_key(conform(raw_student, entity), entity.key)
        if "mapeamento_municipio" in names:
            entity = PACK["mapeamento_municipio"]
            found[entity.name] = conform(raw_map(spark, sf_dir), entity)
        return found

    found = side_by_side(several, ("areas", "rows"))
    tables = found["areas"] | found["rows"]
    return {n: tables[n] for n in names}


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conformed students, duplicate keys included."""
    return conform(raw_students(spark, sf_dir), PACK["avaliacao_aluno"])
