"""Domain pack for the literacy assessment: entities, code lists, bands, rules.

Names and values in this module are fixed by the data and the tables to deliver. Operators do not
know them.
"""

from __future__ import annotations

from layerwright.spec import CodeList, Entity, Field, ruleset

# Target years, and the score at which each band after the first begins.
TARGET_YEARS = (2024, 2025, 2026, 2027, 2028, 2029, 2030)
BAND_EDGES = (650, 675, 700, 725, 750, 775, 800, 825)
LEVELS = (0, 1, 2, 3, 4, 5, 6, 7, 8)

# School networks as coded for students, for regions, and as model features.
STUDENT_NETWORK = CodeList({1: "Federal", 2: "Estadual", 3: "Municipal"}, other="Privada")
AREA_NETWORK = CodeList(
    {0: "Total", 1: "Federal", 2: "Estadual", 3: "Municipal", 4: "Privada", 5: "Publica (E,M)"},
    other="Publica (F,E,M)",
)
NETWORK_FEATURE = CodeList({"Municipal": 1, "Estadual": 2, "Federal": 3}, other=4)

# Fixed value: label of a place that the municipality map does not hold.
NOT_FOUND = "Não encontrado"

TARGETS = {year: f"meta_{year}" for year in TARGET_YEARS}
SHARE_PREFIX = "pc_nivel_"
SHARES = tuple(f"{SHARE_PREFIX}{level}" for level in LEVELS)

PERCENT = (0, 100)
SCORE = (0, 1000)
LEVEL = (0, 8)


def _target_fields(fill: float | None) -> tuple[Field, ...]:
    return (
        Field("ano", "int"),
        Field("rede", "string", text="title"),
        Field("taxa_alfabetizacao", "double", fill=fill, digits=2),
        Field("percentual_participacao", "double", fill=fill, digits=2),
        *(
            Field(name, "double", source=f"meta_alfabetizacao_{year}", fill=0, optional=True)
            for year, name in TARGETS.items()
        ),
    )


def _area_fields() -> tuple[Field, ...]:
    return (
        Field("ano", "int"),
        Field("serie", "int"),
        Field("rede", "int", codes=AREA_NETWORK),
        Field("taxa_alfabetizacao", "double", fill=0, digits=2),
        Field("media_portugues", "double", fill=0, digits=2),
        *(
            Field(name, "double", source=f"proporcao_aluno_nivel_{level}", fill=0, optional=True)
            for level, name in zip(LEVELS, SHARES)
        ),
    )


def entities(id_type: str = "int") -> dict[str, Entity]:
    """The seven landing entities.

    ``id_type`` is the type of student, school and municipality ids; ``"bigint"`` is for sources
    whose ids outgrow 32 bits, which an int would turn into NULL.
    """
    state = Field("sigla_uf", "string", text="upper")
    town = Field("id_municipio", id_type)
    student = (
        Field("ano", "int"),
        town,
        Field("id_escola", id_type),
        Field("id_aluno", id_type),
        Field("caderno", "int"),
        Field("serie", "int"),
        Field("rede", "int", codes=STUDENT_NETWORK),
        Field("compareceu", "boolean", source="presenca"),
        Field("preencheu_caderno", "boolean", source="preenchimento_caderno"),
        Field("alfabetizado", "boolean"),
        Field("proficiencia", "double", fill=0, digits=2),
        Field("peso_aluno", "double", fill=0, digits=2),
        Field("nivel_alfabetizacao", "double", "proficiencia", fill=0, digits=2, edges=BAND_EDGES),
    )
    place = (town, Field("nome_municipio", "string", text="trim"), state)
    declared = (
        Entity(
            "avaliacao_aluno",
            ("ano", "id_aluno"),
            student,
            ruleset(required=("ano", "id_municipio", "id_escola", "id_aluno")),
        ),
        Entity("meta_brasil", ("ano",), _target_fields(None), ruleset(required=("ano",), unique=("ano",))),
        Entity(
            "meta_municipio",
            ("ano", "id_municipio"),
            (*_target_fields(0), town, Field("nivel_alfabetizacao", "int", fill=0)),
            ruleset(required=("ano", "id_municipio")),
        ),
        Entity(
            "meta_uf",
            ("ano", "sigla_uf"),
            (*_target_fields(0), state),
            ruleset(required=("ano", "sigla_uf")),
        ),
        Entity(
            "municipio",
            ("ano", "id_municipio", "rede"),
            (*_area_fields(), town),
            ruleset(required=("ano", "id_municipio")),
        ),
        Entity("uf", ("ano", "sigla_uf", "rede"), (*_area_fields(), state), ruleset(required=("ano", "sigla_uf"))),
        Entity(
            "mapeamento_municipio",
            ("id_municipio",),
            place,
            ruleset(required=("id_municipio", "nome_municipio", "sigla_uf")),
        ),
    )
    return {e.name: e for e in declared}


FACT_RULES = {
    "fct_avaliacao_aluno": ruleset(
        required=("id_aluno", "ano", "id_escola"),
        ranges={
            SCORE: ("proficiencia", "media_portugues_municipio", "media_portugues_estado"),
            LEVEL: ("nivel_alfabetizacao",),
        },
    ),
    "fct_meta_municipio": ruleset(
        required=("nome_municipio", "sigla_uf", "ano"),
        ranges={
            LEVEL: ("nivel_alfabetizacao_municipal",),
            PERCENT: (
                "taxa_alfabetizacao",
                "taxa_alfabetizacao_municipal",
                "percentual_participacao_municipal",
                "taxa_alfabetizacao_estadual",
                "percentual_participacao_estadual",
                *TARGETS.values(),
            ),
        },
    ),
    "fct_meta_uf": ruleset(
        required=("sigla_uf", "ano"),
        ranges={
            PERCENT: (
                "taxa_alfabetizacao",
                "taxa_alfabetizacao_estadual",
                "percentual_participacao_estadual",
                "taxa_alfabetizacao_nacional",
                "percentual_participacao_nacional",
                *TARGETS.values(),
            )
        },
    ),
}

MART_RULES = {
    "consolidado_municipio": ruleset(required=("ano", "nome_municipio", "rede")),
    "consolidado_uf": ruleset(required=("ano", "sigla_uf", "rede")),
    "distribuicao_niveis": ruleset(
        required=("ano", "sigla_uf", "nome_municipio", "rede"),
        ranges={PERCENT: ("percentual_alunos",)},
    ),
    "estatisticas_escolares": ruleset(
        required=("ano", "sigla_uf", "nome_municipio", "id_escola", "rede"),
        ranges={PERCENT: ("percentual_faltantes", "taxa_alfabetizacao_escola"), SCORE: ("media_proficiencia",)},
    ),
    "ml_aluno": ruleset(
        required=("ano", "id_aluno", "feat_rede_encoded", "feat_peso_aluno"),
        ranges={SCORE: ("feat_media_proficiencia_escola",)},
    ),
}

# Columns of the tables to deliver, in order, without the run's own columns.
TARGET_COLUMNS = tuple(TARGETS.values())
DELIVERED = {
    "fct_avaliacao_aluno": (
        "id_aluno", "ano", "rede", "proficiencia", "peso_aluno", "compareceu", "preencheu_caderno", "alfabetizado",
        "nivel_alfabetizacao", "id_escola", "nome_municipio", "sigla_uf", "media_portugues_municipio", "media_portugues_estado",
    ),
    "fct_meta_municipio": (
        "nome_municipio", "sigla_uf", "ano", "rede", "taxa_alfabetizacao", "nivel_alfabetizacao_municipal",
        "taxa_alfabetizacao_municipal", "percentual_participacao_municipal", "taxa_alfabetizacao_estadual",
        "percentual_participacao_estadual", *TARGET_COLUMNS,
    ),
    "fct_meta_uf": (
        "sigla_uf", "ano", "rede", "taxa_alfabetizacao", "taxa_alfabetizacao_estadual", "percentual_participacao_estadual",
        "taxa_alfabetizacao_nacional", "percentual_participacao_nacional", *TARGET_COLUMNS,
    ),
    "consolidado_municipio": (
        "ano", "sigla_uf", "nome_municipio", "rede", "taxa_alfabetizacao_real", "meta_alfabetizacao_esperada",
        "percentual_participacao", "taxa_alfabetizacao_referencia_estado", "atingiu_meta", "diff_meta",
    ),
    "consolidado_uf": (
        "ano", "sigla_uf", "rede", "taxa_alfabetizacao_real_uf", "meta_alfabetizacao_esperada_uf", "percentual_participacao_uf",
        "taxa_alfabetizacao_referencia_brasil", "uf_atingiu_meta", "diff_meta",
    ),
    "distribuicao_niveis": (
        "ano", "sigla_uf", "nome_municipio", "rede", "nivel_alfabetizacao", "quantidade_alunos", "percentual_alunos",
    ),
    "estatisticas_escolares": (
        "ano", "sigla_uf", "nome_municipio", "id_escola", "rede", "total_alunos", "total_alunos_presentes",
        "percentual_faltantes", "media_proficiencia", "desvio_padrao_proficiencia", "taxa_alfabetizacao_escola",
    ),
    "ml_aluno": (
        "ano", "id_aluno", "feat_rede_encoded", "feat_peso_aluno", "feat_media_proficiencia_escola",
        "feat_media_portugues_municipio", "feat_media_portugues_estado", "target_alfabetizado", "target_nivel_alfabetizacao",
    ),
}
