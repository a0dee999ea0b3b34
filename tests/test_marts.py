from conftest import rows
from pyspark.sql import functions as F

from layerwright import plans
from layerwright.literacy import NOT_FOUND, TARGETS, entities
from layerwright.operators import conform

PACK = entities()

FACT = (
    "id_aluno int, ano int, rede string, proficiencia double, peso_aluno double, compareceu boolean,"
    " preencheu_caderno boolean, alfabetizado boolean, nivel_alfabetizacao int, id_escola int,"
    " nome_municipio string, sigla_uf string, media_portugues_municipio double, media_portugues_estado double"
)


def fact(spark, *students):
    """Students as (id, school, score, came, filled, literate, level)."""
    return spark.createDataFrame(
        [
            (i, 2024, "Municipal", score, 1.25, came, filled, literate, level, school, "Town", "SP", 1.5, 2.5)
            for i, school, score, came, filled, literate, level in students
        ],
        FACT,
    )


def test_school_statistics_edges(spark):
    schools = fact(
        spark,
        (1, 10, 700.0, True, True, True, 3),
        (2, 10, 0.0, False, True, False, 0),
        (3, 10, 0.0, None, None, None, 0),
        (4, 20, 0.0, False, False, False, 0),
        (5, 30, 600.0, True, True, None, 0),
        (6, 30, 650.0, True, True, True, 1),
        (None, 30, 655.0, True, True, True, 1),
    )
    found = {r["id_escola"]: r.asDict() for r in plans.school_statistics(schools).collect()}
    one, none, three = found[10], found[20], found[30]
    assert (one["total_alunos"], one["total_alunos_presentes"], one["percentual_faltantes"]) == (3, 1, 33.33)
    assert (one["media_proficiencia"], one["desvio_padrao_proficiencia"]) == (700.0, 0.0)
    assert (none["media_proficiencia"], none["taxa_alfabetizacao_escola"], none["percentual_faltantes"]) == (0, 0, 100)
    assert (three["total_alunos"], three["total_alunos_presentes"]) == (2, 3)
    assert (three["desvio_padrao_proficiencia"], three["taxa_alfabetizacao_escola"]) == (30.41, 66.67)


def test_attendance_parts_add_up(spark):
    from catalogue.queries import fact_student

    df = fact_student(spark, "/root/testdata/sf0.001")
    stats = plans.school_statistics(df)
    bad = stats.where("total_alunos_presentes > total_alunos OR percentual_faltantes NOT BETWEEN 0 AND 100")
    assert bad.count() == 0
    shares = plans.level_distribution(df).groupBy("ano", "sigla_uf", "nome_municipio", "rede")
    off = shares.agg(F.abs(F.sum("percentual_alunos") - 100).alias("d"), F.count("*").alias("n"))
    assert off.where("d > 0.005 * n + 1e-9").count() == 0


def test_level_distribution_counts_assessed_students_only(spark):
    found = plans.level_distribution(
        fact(
            spark,
            (1, 1, 700.0, True, True, True, 3),
            (2, 1, 700.0, True, True, True, 3),
            (3, 2, 0.0, True, True, False, 0),
            (4, 2, 0.0, True, None, False, 0),
            (5, 2, 0.0, False, True, False, 0),
        )
    )
    assert rows(found.select("nivel_alfabetizacao", "quantidade_alunos", "percentual_alunos")) == [
        (0, 1, 33.33),
        (3, 2, 66.67),
    ]


def test_student_features(spark):
    students = fact(
        spark,
        (1, 1, 700.0, True, True, None, 3),
        (2, 1, 701.0, True, True, True, 3),
        (3, 1, 100.0, True, False, True, 0),
    ).withColumn("rede", F.when(F.col("id_aluno") == 1, "Federal").otherwise("Privada"))
    found = plans.student_features(students)
    assert found.columns == [
        "ano", "id_aluno", "feat_rede_encoded", "feat_peso_aluno", "feat_media_proficiencia_escola",
        "feat_media_portugues_municipio", "feat_media_portugues_estado", "target_alfabetizado",
        "target_nivel_alfabetizacao",
    ]
    assert rows(found) == [
        (2024, 1, 3, 1.25, 700.5, 1.5, 2.5, 0, 3),
        (2024, 2, 4, 1.25, 700.5, 1.5, 2.5, 1, 3),
    ]


AREA = (
    "nome_municipio string, sigla_uf string, ano int, rede string, taxa_alfabetizacao double,"
    " percentual_participacao_municipal double, taxa_alfabetizacao_estadual double, "
) + ", ".join(f"{c} double" for c in TARGETS.values())


def area(spark, *places):
    """Places as (name, year, rate, target of every year)."""
    return spark.createDataFrame(
        [(n, "SP", y, "Total", rate, 90.0, 50.0, *([target] * len(TARGETS))) for n, y, rate, target in places], AREA
    )


def test_targets(spark):
    places = area(spark, ("a", 2024, 55.0, 40.0), ("b", 2030, 39.99, 40.0), ("c", 2023, 10.0, 40.0), ("d", 2025, 5.0, 0.0))
    found = {r["nome_municipio"]: r for r in plans.area_targets(places).collect()}
    judged = {n: (r["meta_alfabetizacao_esperada"], r["atingiu_meta"]) for n, r in found.items()}
    assert judged == {"a": (40.0, True), "b": (40.0, False), "c": (0.0, True), "d": (0.0, True)}
    assert found["a"]["diff_meta"] == 15.0
    strict = {r["nome_municipio"]: r for r in plans.area_targets(places, "null").collect()}
    assert (strict["c"]["meta_alfabetizacao_esperada"], strict["c"]["atingiu_meta"]) == (None, False)
    assert (strict["d"]["diff_meta"], strict["a"]["atingiu_meta"]) == (None, True)


def test_fan_out_is_averaged(spark):
    twice = area(spark, ("a", 2024, 50.0, 40.0), ("a", 2024, 51.0, 43.0))
    (row,) = plans.area_targets(twice).collect()
    assert (row["taxa_alfabetizacao_real"], row["meta_alfabetizacao_esperada"]) == (50.5, 41.5)


def test_national_rate_may_stay_null(spark):
    columns = "sigla_uf string, ano int, rede string, taxa_alfabetizacao double, percentual_participacao_estadual double,"
    columns += " taxa_alfabetizacao_nacional double, " + ", ".join(f"{c} double" for c in TARGETS.values())
    df = spark.createDataFrame([("SP", 2024, "Total", 50.0, 90.0, None, *([60.0] * 7))], columns)
    (row,) = plans.state_targets(df).collect()
    assert (row["taxa_alfabetizacao_referencia_brasil"], row["uf_atingiu_meta"], row["diff_meta"]) == (None, False, -10.0)


def entity(spark, name, columns, *data):
    return conform(spark.createDataFrame(list(data), columns), PACK[name])


def tables(spark):
    """Town 1 is known, town 2 is missing from the map."""
    metas = ", ".join(f"meta_alfabetizacao_{y} double" for y in TARGETS)
    goals = [40.0 + i for i in range(7)]
    indicators = "rede int, serie int, taxa_alfabetizacao double, media_portugues double"
    return {
        "avaliacao_aluno": entity(
            spark, "avaliacao_aluno",
            "ano int, id_municipio int, id_escola int, id_aluno int, caderno int, serie int, rede int, presenca int,"
            " preenchimento_caderno int, alfabetizado int, proficiencia double, peso_aluno double",
            (2024, 1, 5, 100, 1, 2, 3, 1, 1, 1, 750.0, 1.0),
            (2024, 2, 6, 101, 1, 2, 3, 1, 1, 0, 700.0, 1.0),
            (2024, None, 7, 102, 1, 2, 9, 0, 0, 0, None, None),
        ),
        "mapeamento_municipio": entity(
            spark, "mapeamento_municipio", "id_municipio int, nome_municipio string, sigla_uf string", (1, " Town ", " sp ")
        ),
        "municipio": entity(
            spark, "municipio", "ano int, id_municipio int, " + indicators,
            (2024, 1, 3, 2, 60.0, 710.0), (2024, 1, 0, 2, 61.0, 711.0), (2024, 2, 3, 2, 62.0, 712.0),
        ),
        "uf": entity(spark, "uf", "ano int, sigla_uf string, " + indicators, (2024, "sp", 3, 2, 63.0, 713.0)),
        "meta_municipio": entity(
            spark, "meta_municipio",
            "ano int, id_municipio int, rede string, taxa_alfabetizacao double, percentual_participacao double,"
            " nivel_alfabetizacao int, " + metas,
            (2024, 1, "publica", 64.0, 94.0, 3, *goals), (2024, 2, "publica", 65.0, 95.0, 3, *goals),
        ),
        "meta_uf": entity(
            spark, "meta_uf",
            "ano int, sigla_uf string, rede string, taxa_alfabetizacao double, percentual_participacao double, " + metas,
            (2024, "SP", "publica", 66.0, 96.0, *goals),
        ),
        "meta_brasil": entity(
            spark, "meta_brasil",
            "ano int, rede string, taxa_alfabetizacao double, percentual_participacao double, " + metas,
            (2024, "publica", None, 97.0, *goals),
        ),
    }


def test_student_fact_keeps_unmatched_students(spark):
    found = plans.student_fact(tables(spark))
    assert [f"{n} {t}" for n, t in found.dtypes] == [c.strip().replace("boolean", "boolean") for c in FACT.split(",")]
    assert rows(found.select("id_aluno", "rede", "nome_municipio", "sigla_uf", "media_portugues_municipio", "media_portugues_estado")) == [
        (100, "Municipal", "Town", "SP", 710.0, 713.0),
        (101, "Municipal", NOT_FOUND, NOT_FOUND, 712.0, 0.0),
        (102, "Privada", NOT_FOUND, NOT_FOUND, 0.0, 0.0),
    ]


def test_area_fact_fans_out_by_network_and_loses_unmatched(spark):
    found = plans.area_target_fact(tables(spark))
    assert len(found.columns) == 17
    assert rows(found.select("nome_municipio", "rede", "taxa_alfabetizacao", "taxa_alfabetizacao_municipal", "taxa_alfabetizacao_estadual")) == [
        ("Town", "Municipal", 60.0, 64.0, 66.0),
        ("Town", "Total", 61.0, 64.0, 66.0),
    ]
    assert plans.area_dimension(tables(spark)).where(F.col("nome_municipio") == NOT_FOUND).count() == 1


def test_state_fact(spark):
    found = plans.state_target_fact(tables(spark))
    assert len(found.columns) == 15
    (row,) = found.collect()
    assert (row["rede"], row["taxa_alfabetizacao"], row["taxa_alfabetizacao_estadual"]) == ("Municipal", 63.0, 66.0)
    assert (row["taxa_alfabetizacao_nacional"], row["percentual_participacao_nacional"]) == (None, 97.0)


def test_facts_are_the_same_by_shuffle(spark, no_broadcast):
    t = tables(spark)
    assert plans.student_fact(t).count() == 3
    assert plans.area_target_fact(t).count() == 2
    assert plans.state_target_fact(t).count() == 1
