"""SQL building blocks that state independently what the stand-in entities, facts and marts hold."""

from __future__ import annotations

from layerwright.literacy import LEVELS, NOT_FOUND, TARGET_YEARS


def half_up(expr: str) -> str:
    """Round to 2 places on the printed decimal value, as Spark does."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE)"


def band(expr: str) -> str:
    """Bands of 25 points from 650 to 825."""
    return f"CAST(greatest(0, least(8, floor((({expr}) - 625) / 25))) AS INTEGER)"


def rate(part: str, whole: str) -> str:
    return f"(100.0::DOUBLE * {part} / nullif({whole}, 0))"


def each(template: str, values, sep: str = ", ") -> str:
    return sep.join(template.format(v=v) for v in values)


LITERATE = "l_returnflag <> 'R' AND 600 + l_quantity * 5 >= 743"
STATE_CODE = "'  ' || lower(left(r_name, 2)) || ' '"
SUMS = ["students", "present", "literate", "score", *(f"level_{n}" for n in LEVELS)]
METAS = [f"meta_{y}" for y in TARGET_YEARS]
STUDENT_NETWORK = "CASE rede WHEN 1 THEN 'Federal' WHEN 2 THEN 'Estadual' WHEN 3 THEN 'Municipal' ELSE 'Privada' END"
AREA_NETWORK = (
    "CASE rede WHEN 0 THEN 'Total' WHEN 1 THEN 'Federal' WHEN 2 THEN 'Estadual' WHEN 3 THEN 'Municipal'"
    " WHEN 4 THEN 'Privada' WHEN 5 THEN 'Publica (E,M)' ELSE 'Publica (F,E,M)' END"
)


def target_of_year(year: str = "ano") -> str:
    whens = " ".join(f"WHEN {y} THEN meta_{y}" for y in TARGET_YEARS)
    return f"CASE {year} {whens} ELSE 0.0::DOUBLE END"


def _sums(source: str, keys: str) -> str:
    totals = ", ".join(f"CAST(sum({c}) AS {'DOUBLE' if c == 'score' else 'BIGINT'}) AS {c}" for c in SUMS)
    return f"SELECT {keys}, {totals} FROM {source} GROUP BY {keys}"


def _raw_indicators(source: str, keys: str) -> str:
    shares = ", ".join(f"{rate(f'level_{n}', 'present')} AS proporcao_aluno_nivel_{n}" for n in LEVELS)
    return (
        f"SELECT {keys}, 2 AS serie, {rate('literate', 'students')} AS taxa_alfabetizacao,"
        f" score / nullif(present, 0) AS media_portugues, {shares} FROM ({source})"
    )


def _indicators(raw: str, place: str) -> str:
    shares = ", ".join(f"coalesce(proporcao_aluno_nivel_{n}, 0) AS pc_nivel_{n}" for n in LEVELS)
    return (
        f"SELECT ano, serie, {AREA_NETWORK} AS rede,"
        f" {half_up('coalesce(taxa_alfabetizacao, 0)')} AS taxa_alfabetizacao,"
        f" {half_up('coalesce(media_portugues, 0)')} AS media_portugues, {shares}, {place} FROM {raw}"
    )


def _raw_targets(source: str, keys: str, offset: str) -> str:
    metas = ", ".join(
        f"CAST(40 + {offset} + 5 * ({y} - 2024) AS DOUBLE) AS meta_alfabetizacao_{y}" for y in TARGET_YEARS
    )
    return (
        f"SELECT {keys}, ' PUBLICA ' AS rede, {rate('literate', 'students')} AS taxa_alfabetizacao,"
        f" {rate('present', 'students')} AS percentual_participacao, {metas} FROM ({source})"
    )


def _targets(raw: str, extra: str = "") -> str:
    metas = ", ".join(f"coalesce(meta_alfabetizacao_{y}, 0) AS meta_{y}" for y in TARGET_YEARS)
    return (
        f"SELECT ano, 'Publica' AS rede, {half_up('taxa_alfabetizacao')} AS taxa_alfabetizacao,"
        f" {half_up('percentual_participacao')} AS percentual_participacao, {metas}{extra} FROM {raw}"
    )


FIRST_BY = (
    "id_municipio, id_escola, caderno, serie, rede, compareceu, preencheu_caderno, alfabetizado,"
    " proficiencia, peso_aluno, nivel_alfabetizacao"
)

CTES = {
    "raw_student": f"""
        SELECT CAST(year(l_shipdate) + 29 AS INTEGER) AS ano, CAST(s_nationkey AS BIGINT) AS id_municipio,
          l_suppkey AS id_escola, l_orderkey * 10 + l_linenumber AS id_aluno, l_linenumber AS caderno,
          2 AS serie, l_linenumber % 5 AS rede, CAST(l_returnflag <> 'R' AS INTEGER) AS presenca,
          CAST(l_linestatus = 'F' AS INTEGER) AS preenchimento_caderno,
          CAST({LITERATE} AS INTEGER) AS alfabetizado,
          CASE WHEN l_returnflag <> 'R' THEN 600 + l_quantity * 5 END AS proficiencia, 1 + l_tax AS peso_aluno
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "student": f"""
        SELECT ano, id_municipio, id_escola, id_aluno, caderno, serie, {STUDENT_NETWORK} AS rede,
          presenca = 1 AS compareceu, preenchimento_caderno = 1 AS preencheu_caderno,
          alfabetizado = 1 AS alfabetizado, {half_up('coalesce(proficiencia, 0)')} AS proficiencia,
          {half_up('coalesce(peso_aluno, 0)')} AS peso_aluno,
          {band(half_up('coalesce(proficiencia, 0)'))} AS nivel_alfabetizacao
        FROM raw_student""",
    "student_1": f"""
        SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY ano, id_aluno
          ORDER BY {FIRST_BY}) AS nth FROM student) WHERE nth = 1""",
    "place": """
        SELECT CAST(CASE n_nationkey WHEN 24 THEN 999 ELSE n_nationkey END AS BIGINT) AS id_municipio,
          n_name AS nome_municipio, upper(left(r_name, 2)) AS sigla_uf
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "raw_map": "SELECT id_municipio, nome_municipio, lower(sigla_uf) AS sigla_uf FROM place",
    "area_sums": f"""
        SELECT ano, id_municipio, rede, count(*) AS students, CAST(sum(presenca) AS BIGINT) AS present,
          CAST(sum(alfabetizado) AS BIGINT) AS literate, sum(proficiencia) AS score,
          {", ".join(f"count_if(presenca = 1 AND {band('proficiencia')} = {n}) AS level_{n}" for n in LEVELS)}
        FROM raw_student GROUP BY ano, id_municipio, rede""",
    "state_sums": f"""
        SELECT a.*, r_regionkey, {STATE_CODE} AS sigla_uf FROM area_sums a
        JOIN nation ON id_municipio = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "raw_municipio": _raw_indicators("SELECT * FROM area_sums", "ano, id_municipio, rede"),
    "raw_uf": _raw_indicators(_sums("state_sums", "ano, sigla_uf, rede"), "ano, sigla_uf, rede"),
    "municipio": _indicators("raw_municipio", "id_municipio"),
    "uf": _indicators("raw_uf", "upper(trim(sigla_uf)) AS sigla_uf"),
    "raw_meta_brasil": _raw_targets(_sums("area_sums", "ano"), "ano", "0"),
    "raw_meta_municipio": _raw_targets(
        _sums("area_sums", "ano, id_municipio"),
        "ano, id_municipio, CAST(nullif(id_municipio % 9, 8) AS INTEGER) AS nivel_alfabetizacao",
        "id_municipio",
    ),
    "raw_meta_uf": _raw_targets(_sums("state_sums", "ano, sigla_uf, r_regionkey"), "ano, sigla_uf", "r_regionkey"),
    "meta_brasil": _targets("raw_meta_brasil"),
    "meta_municipio": _targets(
        "raw_meta_municipio", ", id_municipio, coalesce(nivel_alfabetizacao, 0) AS nivel_alfabetizacao"
    ),
    "meta_uf": _targets("raw_meta_uf", ", upper(trim(sigla_uf)) AS sigla_uf"),
    "fct_student": f"""
        SELECT id_aluno, s.ano, s.rede, proficiencia, peso_aluno, compareceu, preencheu_caderno, alfabetizado,
          nivel_alfabetizacao, id_escola, coalesce(nome_municipio, '{NOT_FOUND}') AS nome_municipio,
          coalesce(p.sigla_uf, '{NOT_FOUND}') AS sigla_uf,
          coalesce(m.media_portugues, 0) AS media_portugues_municipio,
          coalesce(u.media_portugues, 0) AS media_portugues_estado
        FROM student_1 s LEFT JOIN place p ON s.id_municipio = p.id_municipio
          LEFT JOIN municipio m ON s.ano = m.ano AND s.id_municipio = m.id_municipio AND s.rede = m.rede
          LEFT JOIN uf u ON s.ano = u.ano AND p.sigla_uf = u.sigla_uf AND s.rede = u.rede""",
    "dim_area": f"""
        SELECT ano, m.id_municipio, coalesce(nome_municipio, '{NOT_FOUND}') AS nome_municipio,
          coalesce(sigla_uf, '{NOT_FOUND}') AS sigla_uf, serie, rede, taxa_alfabetizacao, media_portugues,
          {each("pc_nivel_{v}", LEVELS)}
        FROM municipio m LEFT JOIN place p ON m.id_municipio = p.id_municipio""",
    "fct_area": f"""
        SELECT d.nome_municipio, d.sigla_uf, d.ano, d.rede, d.taxa_alfabetizacao,
          t.nivel_alfabetizacao AS nivel_alfabetizacao_municipal,
          t.taxa_alfabetizacao AS taxa_alfabetizacao_municipal,
          t.percentual_participacao AS percentual_participacao_municipal,
          u.taxa_alfabetizacao AS taxa_alfabetizacao_estadual,
          u.percentual_participacao AS percentual_participacao_estadual, {each("t.{v}", METAS)}
        FROM meta_municipio t JOIN dim_area d ON t.ano = d.ano AND t.id_municipio = d.id_municipio
          JOIN meta_uf u ON u.ano = d.ano AND u.sigla_uf = d.sigla_uf""",
    "fct_state": f"""
        SELECT t.sigla_uf, t.ano, u.rede, u.taxa_alfabetizacao,
          t.taxa_alfabetizacao AS taxa_alfabetizacao_estadual,
          t.percentual_participacao AS percentual_participacao_estadual,
          b.taxa_alfabetizacao AS taxa_alfabetizacao_nacional,
          b.percentual_participacao AS percentual_participacao_nacional, {each("t.{v}", METAS)}
        FROM meta_uf t JOIN uf u ON t.ano = u.ano AND t.sigla_uf = u.sigla_uf JOIN meta_brasil b ON t.ano = b.ano""",
    "mart_area": f"""
        SELECT *, taxa_alfabetizacao_real >= meta_alfabetizacao_esperada AS atingiu_meta,
          taxa_alfabetizacao_real - meta_alfabetizacao_esperada AS diff_meta
        FROM (SELECT ano, sigla_uf, nome_municipio, rede,
          {half_up('avg(taxa_alfabetizacao)')} AS taxa_alfabetizacao_real,
          {half_up(f'avg({target_of_year()})')} AS meta_alfabetizacao_esperada,
          {half_up('avg(percentual_participacao_municipal)')} AS percentual_participacao,
          {half_up('avg(taxa_alfabetizacao_estadual)')} AS taxa_alfabetizacao_referencia_estado
        FROM fct_area GROUP BY ano, sigla_uf, nome_municipio, rede)""",
    "mart_state": f"""
        SELECT *, taxa_alfabetizacao_real_uf >= meta_alfabetizacao_esperada_uf AS uf_atingiu_meta,
          taxa_alfabetizacao_real_uf - meta_alfabetizacao_esperada_uf AS diff_meta
        FROM (SELECT ano, sigla_uf, rede,
          {half_up('avg(taxa_alfabetizacao)')} AS taxa_alfabetizacao_real_uf,
          {half_up(f'avg({target_of_year()})')} AS meta_alfabetizacao_esperada_uf,
          {half_up('avg(percentual_participacao_estadual)')} AS percentual_participacao_uf,
          {half_up('avg(taxa_alfabetizacao_nacional)')} AS taxa_alfabetizacao_referencia_brasil
        FROM fct_state GROUP BY ano, sigla_uf, rede)""",
    "mart_levels": f"""
        SELECT ano, sigla_uf, nome_municipio, rede, nivel_alfabetizacao, quantidade_alunos,
          {half_up('''quantidade_alunos / CAST(sum(quantidade_alunos)
            OVER (PARTITION BY ano, sigla_uf, nome_municipio, rede) AS DOUBLE) * 100''')} AS percentual_alunos
        FROM (SELECT ano, sigla_uf, nome_municipio, rede, nivel_alfabetizacao, count(id_aluno) AS quantidade_alunos
          FROM fct_student WHERE compareceu AND preencheu_caderno GROUP BY ALL)""",
    "mart_schools": f"""
        SELECT ano, sigla_uf, nome_municipio, id_escola, rede, count(id_aluno) AS total_alunos,
          count_if(compareceu)::BIGINT AS total_alunos_presentes,
          {half_up('count_if(NOT compareceu) / CAST(count(id_aluno) AS DOUBLE) * 100')} AS percentual_faltantes,
          coalesce({half_up('avg(proficiencia) FILTER (compareceu)')}, 0) AS media_proficiencia,
          coalesce({half_up('stddev_samp(proficiencia) FILTER (compareceu)')}, 0) AS desvio_padrao_proficiencia,
          coalesce({half_up('''count_if(compareceu AND alfabetizado)
            / CAST(nullif(count_if(compareceu), 0) AS DOUBLE) * 100''')}, 0) AS taxa_alfabetizacao_escola
        FROM fct_student GROUP BY ano, sigla_uf, nome_municipio, id_escola, rede""",
    "features": f"""
        SELECT ano, id_aluno,
          CAST(CASE rede WHEN 'Municipal' THEN 1 WHEN 'Estadual' THEN 2 WHEN 'Federal' THEN 3 ELSE 4 END AS INTEGER)
            AS feat_rede_encoded,
          peso_aluno AS feat_peso_aluno,
          {half_up('avg(proficiencia) OVER (PARTITION BY ano, id_escola)')} AS feat_media_proficiencia_escola,
          media_portugues_municipio AS feat_media_portugues_municipio,
          media_portugues_estado AS feat_media_portugues_estado,
          CAST(alfabetizado AS INTEGER) AS target_alfabetizado,
          nivel_alfabetizacao AS target_nivel_alfabetizacao
        FROM fct_student WHERE compareceu AND preencheu_caderno""",
}

PRELUDE = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in CTES.items())


def over_entities(body: str) -> str:
    """A query that may use any of the tables above."""
    return f"{PRELUDE}\n{body}"
