"""Gold marts, from the silver facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerwright.functions import (
    count_where,
    fill_number,
    half_up,
    label,
    mean_where,
    percent,
    percent_or_zero,
    stddev_where,
    value_for_year,
)
from layerwright.literacy import NETWORK_FEATURE, TARGETS
from layerwright.operators.groups import group_means, share_of_total, shares, with_group_mean, with_target_gap
from layerwright.operators.partials import deviation_of, mean_of, merged, moments


def _with_current_target(fact: DataFrame, missing_target: str) -> DataFrame:
    current = value_for_year(F.col("ano"), TARGETS, missing_target)
    return fact.withColumn("_target", current)


def area_targets(fact: DataFrame, missing_target: str = "zero") -> DataFrame:
    """Municipalities against the target of the year, per network."""
    means = group_means(
        _with_current_target(fact, missing_target),
        ("ano", "sigla_uf", "nome_municipio", "rede"),
        {
            "taxa_alfabetizacao_real": "taxa_alfabetizacao",
            "meta_alfabetizacao_esperada": "_target",
            "percentual_participacao": "percentual_participacao_municipal",
            "taxa_alfabetizacao_referencia_estado": "taxa_alfabetizacao_estadual",
        },
    )
    return with_target_gap(
        means, "taxa_alfabetizacao_real", "meta_alfabetizacao_esperada", "atingiu_meta", "diff_meta"
    )


def state_targets(fact: DataFrame, missing_target: str = "zero") -> DataFrame:
    """States against the target of the year and the national rate, per network."""
    means = group_means(
        _with_current_target(fact, missing_target),
        ("ano", "sigla_uf", "rede"),
        {
            "taxa_alfabetizacao_real_uf": "taxa_alfabetizacao",
            "meta_alfabetizacao_esperada_uf": "_target",
            "percentual_participacao_uf": "percentual_participacao_estadual",
            "taxa_alfabetizacao_referencia_brasil": "taxa_alfabetizacao_nacional",
        },
    )
    return with_target_gap(
        means,
        "taxa_alfabetizacao_real_uf",
        "meta_alfabetizacao_esperada_uf",
        "uf_atingiu_meta",
        "diff_meta",
    )


def assessed(fact: DataFrame) -> DataFrame:
    """Students who came and filled in the booklet; an unknown flag leaves the student out."""
    return fact.where(F.col("compareceu") & F.col("preencheu_caderno"))


LEVEL_KEYS = ("ano", "sigla_uf", "nome_municipio", "rede")
LEVEL = "nivel_alfabetizacao"


def level_distribution(fact: DataFrame) -> DataFrame:
    """How the assessed students of a year, place and network spread over the levels."""
    return share_of_total(
        assessed(fact),
        keys=LEVEL_KEYS,
        part=LEVEL,
        counted="id_aluno",
        count="quantidade_alunos",
        share="percentual_alunos",
    )


def level_sums(fact: DataFrame) -> DataFrame:
    """What ``levels_of`` needs of some students, in rows that add up."""
    return assessed(fact).groupBy(*LEVEL_KEYS, LEVEL).agg(F.count("id_aluno").alias("quantidade_alunos"))


def levels_of(sums: DataFrame) -> DataFrame:
    """``level_distribution`` of all students that are in the sums."""
    counts = merged(sums, (*LEVEL_KEYS, LEVEL), ("quantidade_alunos",))
    return shares(counts, LEVEL_KEYS, "quantidade_alunos", "percentual_alunos")


SCHOOL_KEYS = ("ano", "sigla_uf", "nome_municipio", "id_escola", "rede")


def _school_counts() -> dict[str, Column]:
    came = F.col("compareceu")
    return {
        "total_alunos": F.count("id_aluno"),
        "total_alunos_presentes": count_where(came),
        "_absent": count_where(~came),
        "_literate": count_where(came & F.col("alfabetizado")),
    }


def school_statistics(fact: DataFrame) -> DataFrame:
    """Attendance, scores and literacy rate per school, in one aggregation that combines map-side."""
    came, score = F.col("compareceu"), F.col("proficiencia")
    sums = fact.groupBy(*SCHOOL_KEYS).agg(
        *(c.alias(name) for name, c in _school_counts().items()),
        half_up(mean_where(came, score)).alias("media_proficiencia"),
        half_up(stddev_where(came, score)).alias("desvio_padrao_proficiencia"),
    )
    return _school_columns(sums)


def _school_columns(sums: DataFrame) -> DataFrame:
    return sums.select(
        *SCHOOL_KEYS,
        "total_alunos",
        "total_alunos_presentes",
        percent(F.col("_absent"), F.col("total_alunos")).alias("percentual_faltantes"),
        fill_number(F.col("media_proficiencia"), 0).alias("media_proficiencia"),
        fill_number(F.col("desvio_padrao_proficiencia"), 0).alias("desvio_padrao_proficiencia"),
        percent_or_zero(F.col("_literate"), F.col("total_alunos_presentes")).alias(
            "taxa_alfabetizacao_escola"
        ),
    )


def school_sums(fact: DataFrame) -> DataFrame:
    """What ``schools_of`` needs of some students, in rows that add up."""
    scores = moments(F.when(F.col("compareceu"), F.col("proficiencia")))
    return fact.groupBy(*SCHOOL_KEYS).agg(*(c.alias(name) for name, c in _school_counts().items()), scores.alias("_scores"))


def schools_of(sums: DataFrame) -> DataFrame:
    """``school_statistics`` of all students that are in the sums."""
    total = merged(sums, SCHOOL_KEYS, tuple(_school_counts()), ("_scores",))
    told = {"media_proficiencia": mean_of("_scores"), "desvio_padrao_proficiencia": deviation_of("_scores")}
    return _school_columns(total.withColumns(told))


def student_features(fact: DataFrame) -> DataFrame:
    """Features and labels of the assessed students.

    The school mean holds the student's own score of the same year, so it leaks the label to some
    degree in small schools.
    """
    school = with_group_mean(
        assessed(fact), ("ano", "id_escola"), "proficiencia", "feat_media_proficiencia_escola"
    )
    return school.select(
        "ano",
        "id_aluno",
        label(F.col("rede"), NETWORK_FEATURE).alias("feat_rede_encoded"),
        F.col("peso_aluno").alias("feat_peso_aluno"),
        "feat_media_proficiencia_escola",
        F.col("media_portugues_municipio").alias("feat_media_portugues_municipio"),
        F.col("media_portugues_estado").alias("feat_media_portugues_estado"),
        F.coalesce(F.col("alfabetizado").cast("int"), F.lit(0)).alias("target_alfabetizado"),
        F.col("nivel_alfabetizacao").alias("target_nivel_alfabetizacao"),
    )
