import math

import pytest

from layerwright.literacy import entities
from layerwright.operators import conform

PACK = entities()
STUDENT = "ano string, id_municipio int, id_escola int, id_aluno string, caderno int, serie int, rede int,"
STUDENT += " presenca int, preenchimento_caderno int, alfabetizado int, proficiencia double, peso_aluno double"


def student(spark, **values):
    base = dict(ano="2024", id_municipio=1, id_escola=2, id_aluno="3", caderno=1, serie=2, rede=3, presenca=1)
    base |= dict(preenchimento_caderno=1, alfabetizado=0, proficiencia=700.0, peso_aluno=1.0)
    raw = spark.createDataFrame([tuple((base | values).values())], STUDENT)
    return conform(raw, PACK["avaliacao_aluno"]).first()


@pytest.mark.parametrize(
    "score, rounded, level",
    [(649.996, 650.0, 1), (649.99, 649.99, 0), (825.0, 825.0, 8), (None, 0.0, 0), (math.nan, 0.0, 0)],
)
def test_score_is_filled_and_rounded_before_banding(spark, score, rounded, level):
    row = student(spark, proficiencia=score)
    assert (row["proficiencia"], row["nivel_alfabetizacao"]) == (rounded, level)


def test_student_flags_and_networks(spark):
    row = student(spark, presenca=None, preenchimento_caderno=0, rede=None)
    assert (row["compareceu"], row["preencheu_caderno"], row["rede"]) == (None, False, "Privada")
    assert student(spark, rede=9)["rede"] == "Privada"


def test_bad_numbers_become_null(spark):
    row = student(spark, ano="12a", id_aluno="99999999999")
    assert row["ano"] is None and row["id_aluno"] is None


def test_student_types(spark):
    raw = spark.createDataFrame([], STUDENT)
    assert dict(conform(raw, PACK["avaliacao_aluno"]).dtypes) == {
        "ano": "int", "id_municipio": "int", "id_escola": "int", "id_aluno": "int", "caderno": "int",
        "serie": "int", "rede": "string", "compareceu": "boolean", "preencheu_caderno": "boolean",
        "alfabetizado": "boolean", "proficiencia": "double", "peso_aluno": "double",
        "nivel_alfabetizacao": "int",
    }
    wide = conform(raw, entities("bigint")["avaliacao_aluno"])
    assert dict(wide.dtypes)["id_aluno"] == "bigint"


def test_targets_cast_before_they_are_filled(spark):
    raw = spark.createDataFrame(
        [(2024, " sp ", " publica ", None, None, "-", None)],
        "ano int, sigla_uf string, rede string, taxa_alfabetizacao double, percentual_participacao string,"
        " meta_alfabetizacao_2024 string, meta_alfabetizacao_2026 double",
    )
    row = conform(raw, PACK["meta_uf"]).first().asDict()
    assert row == {
        "ano": 2024, "rede": "Publica", "taxa_alfabetizacao": 0.0, "percentual_participacao": 0.0,
        "meta_2024": 0.0, "meta_2026": 0.0, "sigla_uf": "SP",
    }


def test_national_rates_are_not_filled(spark):
    raw = spark.createDataFrame(
        [(2024, "x", None, 88.886)],
        "ano int, rede string, taxa_alfabetizacao double, percentual_participacao double",
    )
    row = conform(raw, PACK["meta_brasil"]).first()
    assert (row["taxa_alfabetizacao"], row["percentual_participacao"]) == (None, 88.89)


def test_regional_codes_and_shares(spark):
    raw = spark.createDataFrame(
        [(2024, 7, 2, " 5 ", 55.555, None, 10.0, "9"), (2024, 7, 2, None, None, math.nan, None, None)],
        "ano int, id_municipio int, serie int, rede string, taxa_alfabetizacao double, media_portugues double,"
        " proporcao_aluno_nivel_0 double, extra string",
    )
    found = [r.asDict() for r in conform(raw, PACK["municipio"]).collect()]
    assert found == [
        {"ano": 2024, "serie": 2, "rede": "Publica (E,M)", "taxa_alfabetizacao": 55.56, "media_portugues": 0.0,
         "pc_nivel_0": 10.0, "id_municipio": 7},
        {"ano": 2024, "serie": 2, "rede": "Publica (F,E,M)", "taxa_alfabetizacao": 0.0, "media_portugues": 0.0,
         "pc_nivel_0": 0.0, "id_municipio": 7},
    ]


def test_one_projection(spark):
    raw = spark.range(1).selectExpr("id AS id_municipio", "' a ' AS nome_municipio", "'sp' AS sigla_uf")
    logical = conform(raw, PACK["mapeamento_municipio"])._jdf.queryExecution().analyzed().toString()
    assert logical.count("Project") == 2  # the input's own, and one for the entity
