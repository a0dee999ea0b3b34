"""Silver facts, from conformed entities without duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from layerwright.functions import count_where, fill_number, fill_text
from layerwright.literacy import NOT_FOUND, SHARE_PREFIX, TARGETS
from layerwright.operators.conform import select_by_prefix
from layerwright.operators.lookup import lookup_all, lookup_join

Tables = dict[str, DataFrame]
LOST = "_lost"


def _measures(df: DataFrame, keys: tuple[str, ...], **names: str) -> DataFrame:
    """The keys and some measures of a table, under the names they get in the joined result."""
    return df.select(*keys, *(F.col(c).alias(out) for out, c in names.items()))


def _known_place(df: DataFrame) -> DataFrame:
    return df.withColumns({c: fill_text(F.col(c), NOT_FOUND) for c in ("nome_municipio", "sigla_uf")})


def student_fact(tables: Tables) -> DataFrame:
    """Students with their place and the mean scores of their municipality's and state's network.

    The students stay where they are as long as the three small tables fit the broadcast bound, and are shuffled once if not.
    """
    town_key, state_key = ("ano", "id_municipio", "rede"), ("ano", "sigla_uf", "rede")
    town = _measures(tables["municipio"], town_key, media_portugues_municipio="media_portugues")
    state = _measures(tables["uf"], state_key, media_portugues_estado="media_portugues")
    rows = lookup_all(
        tables["avaliacao_aluno"],
        [(tables["mapeamento_municipio"], ("id_municipio",)), (town, town_key), (state, state_key)],
    )
    means = ("media_portugues_municipio", "media_portugues_estado")
    return _known_place(rows).select(
        "id_aluno",
        "ano",
        "rede",
        "proficiencia",
        "peso_aluno",
        "compareceu",
        "preencheu_caderno",
        "alfabetizado",
        "nivel_alfabetizacao",
        "id_escola",
        "nome_municipio",
        "sigla_uf",
        *(fill_number(F.col(c), 0).alias(c) for c in means),
    )


def area_dimension(tables: Tables) -> DataFrame:
    """Municipality indicators per year and network, with the place's name, state and level shares."""
    placed = lookup_join(tables["municipio"], tables["mapeamento_municipio"], "id_municipio")
    kept = (
        "ano",
        "id_municipio",
        "nome_municipio",
        "sigla_uf",
        "serie",
        "rede",
        "taxa_alfabetizacao",
        "media_portugues",
    )
    return select_by_prefix(_known_place(placed), kept, SHARE_PREFIX)


def _kept(rows: DataFrame, reasons: dict[str, Column], seen: Observation | None) -> DataFrame:
    """The rows to which no reason applies. ``seen`` counts the others by the first reason that does."""
    reason = F.coalesce(*(F.when(c, F.lit(name)) for name, c in reasons.items()))
    flagged = rows.withColumn(LOST, reason)
    if seen:
        flagged = flagged.observe(seen, *(count_where(F.col(LOST) == name).alias(name) for name in reasons))
    return flagged


def area_target_rows(tables: Tables, dimension: DataFrame | None = None, seen: Observation | None = None) -> DataFrame:
    """Indicator rows with their targets, and in ``LOST`` why the fact does not hold the row, if so."""
    dimension = area_dimension(tables) if dimension is None else dimension
    keys = ("ano", "id_municipio")
    target = _measures(
        tables["meta_municipio"],
        keys,
        nivel_alfabetizacao_municipal="nivel_alfabetizacao",
        taxa_alfabetizacao_municipal="taxa_alfabetizacao",
        percentual_participacao_municipal="percentual_participacao",
        **{c: c for c in TARGETS.values()},
    ).withColumn("_target", F.lit(True))
    actual = dimension.select(*keys, "nome_municipio", "sigla_uf", "rede", "taxa_alfabetizacao")
    state = _state_rates(tables["meta_uf"]).withColumn("_state", F.lit(True))
    placed = lookup_all(actual, [(target, keys), (state, ("ano", "sigla_uf"))])
    reasons = {
        "no state": F.col("sigla_uf") == NOT_FOUND,
        "no state target": F.col("_state").isNull(),
        "no target": F.col("_target").isNull(),
    }
    return _kept(placed, reasons, seen)


def area_target_fact(tables: Tables, dimension: DataFrame | None = None, seen: Observation | None = None) -> DataFrame:
    """Municipality targets next to actual rates (a row per network) and the state's rates."""
    placed = area_target_rows(tables, dimension, seen).where(F.col(LOST).isNull())
    return placed.select(
        "nome_municipio",
        "sigla_uf",
        "ano",
        "rede",
        "taxa_alfabetizacao",
        "nivel_alfabetizacao_municipal",
        "taxa_alfabetizacao_municipal",
        "percentual_participacao_municipal",
        "taxa_alfabetizacao_estadual",
        "percentual_participacao_estadual",
        *TARGETS.values(),
    )


def _state_rates(targets: DataFrame, *more: str) -> DataFrame:
    return _measures(
        targets,
        ("ano", "sigla_uf"),
        taxa_alfabetizacao_estadual="taxa_alfabetizacao",
        percentual_participacao_estadual="percentual_participacao",
        **{c: c for c in more},
    )


def state_target_rows(tables: Tables, seen: Observation | None = None) -> DataFrame:
    """State indicator rows with their targets, and in ``LOST`` why the fact does not hold the row, if so."""
    target = _state_rates(tables["meta_uf"], *TARGETS.values()).withColumn("_target", F.lit(True))
    actual = tables["uf"].select("ano", "sigla_uf", "rede", "taxa_alfabetizacao")
    nation = _measures(
        tables["meta_brasil"],
        ("ano",),
        taxa_alfabetizacao_nacional="taxa_alfabetizacao",
        percentual_participacao_nacional="percentual_participacao",
    ).withColumn("_nation", F.lit(True))
    placed = lookup_all(actual, [(target, ("ano", "sigla_uf")), (nation, ("ano",))])
    reasons = {"no target": F.col("_target").isNull(), "no national target": F.col("_nation").isNull()}
    return _kept(placed, reasons, seen)


def state_target_fact(tables: Tables, seen: Observation | None = None) -> DataFrame:
    """State targets next to actual rates (a row per network) and the national rates."""
    placed = state_target_rows(tables, seen).where(F.col(LOST).isNull())
    return placed.select(
        "sigla_uf",
        "ano",
        "rede",
        "taxa_alfabetizacao",
        "taxa_alfabetizacao_estadual",
        "percentual_participacao_estadual",
        "taxa_alfabetizacao_nacional",
        "percentual_participacao_nacional",
        *TARGETS.values(),
    )
