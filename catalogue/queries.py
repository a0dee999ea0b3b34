"""The registered queries. Each runs the library over whole benchmark tables, beside its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.oracle import AREA_NETWORK, CTES, METAS, STUDENT_NETWORK, band, each, half_up, over_entities, target_of_year
from catalogue.standin import (
    PACK,
    conformed,
    raw_entities,
    raw_map,
    raw_students,
    students,
    table,
)
from layerwright import functions as LF
from layerwright import operators as op
from layerwright import plans, sources
from layerwright.jobs import side_by_side
from layerwright.literacy import (
    AREA_NETWORK as AREA_CODES,
    BAND_EDGES,
    FACT_RULES,
    LEVELS,
    NETWORK_FEATURE,
    NOT_FOUND,
    SHARE_PREFIX,
    STUDENT_NETWORK as STUDENT_CODES,
    TARGET_YEARS,
    TARGETS,
)
from layerwright.operators.lineage import GOLD_TIME, SILVER_PARTITION
from layerwright.sources.workspace import fresh_path
from layerwright.spec import Entity, Field, Rule, ruleset
from layerwright.streaming import compact_month, ingest_new_files, read_ledger

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# One fixed moment, so that lineage columns can be compared.
STAMP = op.RunStamp(datetime(2026, 7, 14, 12, 30, 45, tzinfo=timezone.utc))


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return register


# Sources and sinks

ORDER = Entity(
    "orders",
    ("o_orderkey",),
    (
        Field("o_orderkey", "bigint"),
        Field("o_custkey", "bigint"),
        Field("o_orderstatus", "string"),
        Field("o_totalprice", "double"),
        Field("o_orderdate", "string"),
        Field("o_orderpriority", "string"),
    ),
    ruleset(required=("o_orderkey", "o_custkey"), unique=("o_orderkey",)),
)
ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", day).select(*ORDER.raw_types)


def _land(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


@query("src_csv", ORDERS_SQL)
def src_csv(spark, sf_dir):
    landing = fresh_path(spark, "landing-orders")
    _land(_orders(spark, sf_dir), landing)
    return sources.read_landing(spark, landing, ORDER.raw_types)


@query(
    "src_csv_inferred",
    """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
      o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, 'date' AS date_type, o_orderpriority FROM orders""",
)
def src_csv_inferred(spark, sf_dir):
    """The date comes out as text, beside the type that was inferred for it."""
    landing = fresh_path(spark, "landing-orders")
    _land(_orders(spark, sf_dir), landing)
    found = sources.read_landing(spark, landing, infer=True)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return found.withColumns({"date_type": F.lit(dict(found.dtypes)["o_orderdate"]), "o_orderdate": day})


UNPARSED_EVERY = 7


@query(
    "bronze_unparsed",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % {UNPARSED_EVERY} <> 0 THEN o_totalprice END AS o_totalprice,
      CASE WHEN o_orderkey % {UNPARSED_EVERY} = 0 THEN 'EUR ' || o_orderkey || ',5' END AS price_text,
      (SELECT count(*) FROM orders WHERE o_orderkey % {UNPARSED_EVERY} = 0) AS n_unparsed,
      (SELECT count(*) FROM orders) AS n_hashes FROM orders""",
)
def bronze_unparsed(spark, sf_dir):
    """Some prices are no numbers: bronze keeps their text, hashes it and counts them."""
    root = fresh_path(spark, "unparsed")
    odd = F.concat(F.lit("EUR "), F.col("o_orderkey").cast("string"), F.lit(",5"))
    price = F.when(F.col("o_orderkey") % UNPARSED_EVERY == 0, odd).otherwise(F.col("o_totalprice").cast("string"))
    _land(_orders(spark, sf_dir).withColumn("o_totalprice", price), f"{root}/landing/orders")
    layout = plans.Layout(f"{root}/landing", f"{root}/bronze", "", "")
    (run,) = plans.run_bronze(spark, layout, STAMP, {"orders": ORDER}, unparsed="report")
    bronze = sources.read_partition(spark, f"{root}/bronze/orders", _ing_ano=2026, _ing_mes=7)
    hashes = bronze.select("_record_hash").distinct().agg(F.count(F.lit(1)).alias("n_hashes"))
    return bronze.select(
        "o_orderkey",
        "o_totalprice",
        F.element_at("_unparsed", F.lit("o_totalprice")).alias("price_text"),
        F.lit(run.unparsed).cast("bigint").alias("n_unparsed"),
    ).join(F.broadcast(hashes))


RAGGED_EVERY = 11
_ODD = f"o_orderkey % {RAGGED_EVERY}"


@query(
    "bronze_ragged",
    f"""WITH lines AS (
      SELECT o_orderkey, concat_ws(',', o_orderkey, o_custkey, o_orderstatus, CAST(o_custkey AS DOUBLE), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority) AS line,
        {_ODD} AS odd FROM orders),
    found AS (
      SELECT o_orderkey, NULL AS line FROM lines WHERE odd > 2
      UNION ALL SELECT NULL, line || ',surplus' FROM lines WHERE odd = 0
      UNION ALL SELECT NULL, o_orderkey || ',short' FROM lines WHERE odd = 1
      UNION ALL SELECT NULL, o_orderkey || ',1,"O' FROM lines WHERE odd = 2
      UNION ALL SELECT NULL, 'rest",1.0,2020-01-01,x' FROM lines WHERE odd = 2)
    SELECT o_orderkey, line, 64 AS hash_length, (SELECT count(line) FROM found) AS n_ragged, 'failed' AS strict_status,
      (SELECT count(*) FROM found WHERE line IS NULL) AS n_silver FROM found""",
)
def bronze_ragged(spark, sf_dir):
    """Lines with too many and too few values, and quoted line breaks: bronze keeps the lines and counts them, a strict run fails, silver leaves them out."""
    root = fresh_path(spark, "ragged")
    text = _orders(spark, sf_dir).withColumn("o_totalprice", F.col("o_custkey").cast("double"))
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in ORDER.raw_types))
    key, odd = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % RAGGED_EVERY
    written = (
        F.when(odd == 0, F.array(F.concat(line, F.lit(",surplus"))))
        .when(odd == 1, F.array(F.concat(key, F.lit(",short"))))
        .when(odd == 2, F.array(F.concat(key, F.lit(',1,"O')), F.lit('rest",1.0,2020-01-01,x')))
        .otherwise(F.array(line))
    )
    layout = plans.Layout(f"{root}/landing", f"{root}/bronze", "", "")
    # One column, whose name is the header and whose values are lines as they are.
    as_it_is = {"header": True, "sep": "\x01", "quote": "", "escapeQuotes": False}
    lines = text.select(F.explode(written).alias(",".join(ORDER.raw_types)))
    lines.write.options(**as_it_is).csv(f"{layout.landing}/orders")
    try:
        plans.run_bronze(spark, layout, STAMP, {"orders": ORDER})
        status = "written"
    except plans.RunFailed as failure:
        status = failure.runs[0].status
    (run,) = plans.run_bronze(spark, layout, STAMP, {"orders": ORDER}, ragged="report")
    bronze = sources.read_partition(spark, f"{layout.bronze}/orders", _ing_ano=2026, _ing_mes=7)
    silver = plans.read_conformed(spark, layout, STAMP, {"orders": ORDER})["orders"]
    return bronze.select(
        "o_orderkey",
        F.col("_ragged").alias("line"),
        F.length("_record_hash").alias("hash_length"),
        F.lit(run.ragged).cast("bigint").alias("n_ragged"),
        F.lit(status).alias("strict_status"),
        F.lit(silver.count()).cast("bigint").alias("n_silver"),
    )


@query(
    "src_parquet_partition",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, CAST(1998 AS INTEGER) AS ano, CAST(7 AS INTEGER) AS mes
    FROM lineitem WHERE year(l_shipdate) = 1998 AND month(l_shipdate) = 7""",
)
def src_parquet_partition(spark, sf_dir):
    """Write the whole table by month, then read one month of it."""
    root = fresh_path(spark, "lines-by-month")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        "l_quantity",
        F.date_format("l_shipdate", "yyyy").alias("ano"),
        F.date_format("l_shipdate", "MM").alias("mes"),
    )
    sources.write_partitioned(lines, root, ("ano", "mes"), keep_others=True, gather=True)
    return sources.read_partition(spark, root, ano=1998, mes=7)


@query(
    "sink_parquet_partitioned",
    """SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS ano, count(*) AS line_count,
      sum(l_linenumber)::BIGINT AS number_sum FROM lineitem GROUP BY ALL""",
)
def sink_parquet_partitioned(spark, sf_dir):
    """Write the whole table by flag and year, then write one flag's rows again: its partitions are
    replaced and the others stay."""
    root = fresh_path(spark, "lines-by-flag")
    by = ("l_returnflag", "ano")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linenumber", F.year("l_shipdate").alias("ano")
    )
    sources.write_partitioned(lines, root, by, keep_others=True, gather=True)
    returned = lines.where(F.col("l_returnflag") == "R")
    sources.write_partitioned(returned, root, by, keep_others=True, gather=True)
    stored = spark.read.parquet(root)
    return stored.groupBy("l_returnflag", "ano").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("l_linenumber").alias("number_sum")
    )


@query(
    "lineage_columns",
    """SELECT o_orderkey, '20260714_123045' AS _ingestion_timestamp, '2026-07-14' AS _ingestion_date,
      true AS from_orders, 'orders' AS _source_entity, '2026' AS _ing_ano, '07' AS _ing_mes FROM orders""",
)
def lineage_columns(spark, sf_dir):
    orders = op.add_lineage(table(spark, sf_dir, "orders"), "orders", STAMP)
    return orders.select(
        "o_orderkey",
        "_ingestion_timestamp",
        "_ingestion_date",
        F.col("_source_file").contains("/orders.parquet").alias("from_orders"),
        "_source_entity",
        "_ing_ano",
        "_ing_mes",
    )


def _orders_with_gaps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        "o_custkey",
    )


HASHED = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"]
GAPS_SQL = """(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
  nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_custkey FROM orders)"""


@query(
    "record_hash",
    f"SELECT o_orderkey, sha256(concat_ws('||', {each('CAST({v} AS VARCHAR)', HASHED)})) AS record_hash FROM {GAPS_SQL}",
)
def record_hash(spark, sf_dir):
    return _orders_with_gaps(spark, sf_dir).select("o_orderkey", LF.record_hash(HASHED).alias("record_hash"))


SAFELY_HASHED = [*HASHED, "before", "after"]


@query(
    "record_hash_null_safe",
    f"""SELECT o_orderkey, sha256(concat(
      {each("coalesce(length(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')", SAFELY_HASHED)})) AS record_hash,
      count(DISTINCT before || '|' || after) OVER () AS n_pairs FROM (SELECT *,
        CASE WHEN o_custkey % 2 = 0 THEN 'a||b' ELSE 'a' END AS before,
        CASE WHEN o_custkey % 2 = 0 THEN 'c' ELSE 'b||c' END AS after FROM {GAPS_SQL})""",
)
def record_hash_null_safe(spark, sf_dir):
    """Two columns hold the separator, in two ways that are one without it."""
    even = F.col("o_custkey") % 2 == 0
    rows = _orders_with_gaps(spark, sf_dir).withColumns(
        {"before": F.when(even, "a||b").otherwise("a"), "after": F.when(even, "c").otherwise("b||c")}
    )
    pair = LF.record_hash(["before", "after"], null_safe=True)
    pairs = rows.select(pair.alias("pair")).distinct().agg(F.count("pair").alias("n_pairs"))
    hashed = LF.record_hash(SAFELY_HASHED, null_safe=True)
    return rows.select("o_orderkey", hashed.alias("record_hash")).join(F.broadcast(pairs))


# Scalars

CASTS_SQL = """SELECT o_orderkey, try_cast(left(o_orderpriority, 1) AS INTEGER) AS digit,
  try_cast(o_orderpriority AS INTEGER) AS not_a_number, CAST(trunc(o_totalprice) AS INTEGER) AS whole_price,
  o_totalprice AS price, try_cast(o_orderkey * 1000000 AS INTEGER) AS too_big,
  CASE o_orderstatus WHEN 'F' THEN false END AS flag FROM orders"""


@query("cast_columns", CASTS_SQL)
def cast_columns(spark, sf_dir):
    """Text columns cast to numbers and flags; what does not fit becomes NULL."""
    text = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.left("o_orderpriority", F.lit(1)).alias("digit"),
        F.col("o_orderpriority").alias("not_a_number"),
        F.col("o_totalprice").cast("string").alias("whole_price"),
        F.col("o_totalprice").cast("string").alias("price"),
        (F.col("o_orderkey") * 1000000).cast("string").alias("too_big"),
        F.col("o_orderstatus").alias("flag"),
    )
    types = {"digit": "int", "not_a_number": "int", "whole_price": "int", "price": "double", "too_big": "int", "flag": "boolean"}
    return sources.landing.typed(text, types)


@query(
    "fill_numeric",
    """SELECT id_aluno, id_escola, presenca, coalesce(proficiencia, 0) AS proficiencia,
      coalesce(CASE WHEN peso_aluno = 1 THEN NULL ELSE peso_aluno END, 0) AS peso_aluno
    FROM (SELECT * FROM raw_student)""".replace("raw_student", f"({CTES['raw_student']})"),
)
def fill_numeric(spark, sf_dir):
    """NULL scores, and weights that are NaN, become 0."""
    weight = F.when(F.col("peso_aluno") == 1, F.lit(float("nan"))).otherwise(F.col("peso_aluno"))
    gaps = raw_students(spark, sf_dir).select(
        "id_aluno", "id_escola", "presenca", "proficiencia", weight.alias("peso_aluno")
    )
    return gaps.withColumns({c: LF.fill_number(F.col(c), 0) for c in ("proficiencia", "peso_aluno")})


@query(
    "fill_text",
    f"""SELECT o_orderkey, coalesce(o_orderstatus, '{NOT_FOUND}') AS o_orderstatus,
      coalesce(o_orderpriority, '{NOT_FOUND}') AS o_orderpriority, o_custkey FROM {GAPS_SQL}""",
)
def fill_text(spark, sf_dir):
    gaps = _orders_with_gaps(spark, sf_dir)
    return gaps.withColumns({c: LF.fill_text(F.col(c), NOT_FOUND) for c in ("o_orderstatus", "o_orderpriority")})


@query(
    "text_normalise",
    "SELECT p_partkey, p_name AS trimmed, upper(p_type) AS uppered, chr(9) || p_brand AS tab_kept FROM part",
)
def text_normalise(spark, sf_dir):
    def padded(c):
        return F.concat(F.lit("  "), F.lower(c) if c == "p_type" else F.col(c), F.lit("   "))

    return table(spark, sf_dir, "part").select(
        "p_partkey",
        LF.clean_text(padded("p_name"), "trim").alias("trimmed"),
        LF.clean_text(padded("p_type"), "upper").alias("uppered"),
        LF.clean_text(F.concat(F.lit(" \t"), "p_brand"), "trim").alias("tab_kept"),
    )


@query(
    "text_initcap",
    """SELECT o_orderkey, array_to_string(list_transform(string_split(lower(o_orderpriority), ' '),
      lambda w: upper(w[1]) || w[2:]), ' ') AS titled FROM orders""",
)
def text_initcap(spark, sf_dir):
    padded = F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))
    return table(spark, sf_dir, "orders").select("o_orderkey", LF.clean_text(padded, "title").alias("titled"))


@query(
    "round_half_up",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {half_up('l_extendedprice * l_discount')} AS discount_2,
      {half_up('(l_quantity * 2 + 1) / 200')} AS tie_2 FROM lineitem""",
)
def round_half_up(spark, sf_dir):
    """Rounded products, and values that lie exactly between two hundredths."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        LF.half_up(F.col("l_extendedprice") * F.col("l_discount")).alias("discount_2"),
        LF.half_up((F.col("l_quantity") * 2 + 1) / 200).alias("tie_2"),
    )


CODES_SQL = "(SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_linenumber - 1, 6) AS rede FROM lineitem)"


def _coded_lines(spark, sf_dir):
    """Codes 0..5 and NULL."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.nullif(F.col("l_linenumber") - 1, F.lit(6)).alias("rede")
    )


@query("label_school_network", f"SELECT l_orderkey, l_linenumber, l_partkey, {STUDENT_NETWORK} AS label FROM {CODES_SQL}")
def label_school_network(spark, sf_dir):
    named = LF.label(F.col("rede"), STUDENT_CODES).alias("label")
    return _coded_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", named)


@query("label_area_network", f"SELECT l_orderkey, l_linenumber, l_partkey, {AREA_NETWORK} AS label FROM {CODES_SQL}")
def label_area_network(spark, sf_dir):
    named = LF.label(F.col("rede"), AREA_CODES).alias("label")
    return _coded_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", named)


@query(
    "encode_category",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE rede WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 4 END
      AS INTEGER) AS code FROM """ + CODES_SQL,
)
def encode_category(spark, sf_dir):
    code = LF.label(LF.label(F.col("rede"), STUDENT_CODES), NETWORK_FEATURE).alias("code")
    return _coded_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", code)


@query(
    "band_score",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {band('600 + l_quantity * 5')} AS level FROM lineitem",
)
def band_score(spark, sf_dir):
    level = LF.band(600 + F.col("l_quantity") * 5, BAND_EDGES).alias("level")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", level)


YEARLY_SQL = f"""(SELECT l_orderkey, l_linenumber, l_partkey, year(l_shipdate) + 28 AS ano,
  {', '.join(f'l_quantity * {i} AS meta_{y}' for i, y in enumerate(TARGET_YEARS))} FROM lineitem)"""


@query(
    "target_for_year",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {target_of_year()} AS target,
      nullif({target_of_year()}, 0) AS target_or_null FROM {YEARLY_SQL}""",
)
def target_for_year(spark, sf_dir):
    """Years 2023 to 2030: the first has no target, and the targets of 2024 are 0."""
    year = F.year("l_shipdate") + 28
    yearly = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        year.alias("ano"),
        *((F.col("l_quantity") * i).alias(TARGETS[y]) for i, y in enumerate(TARGET_YEARS)),
    )
    return yearly.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        LF.value_for_year(F.col("ano"), TARGETS).alias("target"),
        LF.value_for_year(F.col("ano"), TARGETS, missing="null").alias("target_or_null"),
    )


@query("filter_flags", over_entities("SELECT id_aluno, ano, id_escola, proficiencia FROM student WHERE compareceu AND preencheu_caderno"))
def filter_flags(spark, sf_dir):
    kept = plans.marts.assessed(students(spark, sf_dir))
    return kept.select("id_aluno", "ano", "id_escola", "proficiencia")


@query("distinct_projection", over_entities("SELECT DISTINCT ano, id_escola, rede FROM student"))
def distinct_projection(spark, sf_dir):
    return students(spark, sf_dir).select("ano", "id_escola", "rede").distinct()


# Conformed entities


@query("conform_student", over_entities("SELECT * FROM student"))
def conform_student(spark, sf_dir):
    return students(spark, sf_dir)


@query(
    "conform_targets",
    over_entities(
        " UNION ALL ".join(
            f"""SELECT '{e}' AS entity, ano, {place} AS place, rede, taxa_alfabetizacao, percentual_participacao,
              {level} AS nivel, {each("{v}", METAS)} FROM {e}"""
            for e, place, level in (
                ("meta_brasil", "CAST(NULL AS VARCHAR)", "CAST(NULL AS INTEGER)"),
                ("meta_municipio", "CAST(id_municipio AS VARCHAR)", "nivel_alfabetizacao"),
                ("meta_uf", "sigla_uf", "CAST(NULL AS INTEGER)"),
            )
        )
    ),
)
def conform_targets(spark, sf_dir):
    places = {
        "meta_brasil": F.lit(None).cast("string"),
        "meta_municipio": F.col("id_municipio").cast("string"),
        "meta_uf": F.col("sigla_uf"),
    }
    parts = []
    tables = conformed(spark, sf_dir, *places)
    for entity, place in places.items():
        df = tables[entity]
        level = F.col("nivel_alfabetizacao") if "nivel_alfabetizacao" in df.columns else F.lit(None).cast("int")
        parts.append(
            df.select(
                F.lit(entity).alias("entity"),
                "ano",
                place.alias("place"),
                "rede",
                "taxa_alfabetizacao",
                "percentual_participacao",
                level.alias("nivel"),
                *TARGETS.values(),
            )
        )
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


REGIONAL = ["taxa_alfabetizacao", "media_portugues", *(f"pc_nivel_{n}" for n in LEVELS)]


@query(
    "conform_regional",
    over_entities(
        f"""SELECT ano, CAST(id_municipio AS VARCHAR) AS place, serie, rede, {each("{v}", REGIONAL)} FROM municipio
        UNION ALL SELECT ano, sigla_uf, serie, rede, {each("{v}", REGIONAL)} FROM uf"""
    ),
)
def conform_regional(spark, sf_dir):
    town, state = conformed(spark, sf_dir, "municipio", "uf").values()
    columns = ("serie", "rede", *REGIONAL)
    return town.select("ano", F.col("id_municipio").cast("string").alias("place"), *columns).unionAll(
        state.select("ano", F.col("sigla_uf").alias("place"), *columns)
    )


@query(
    "conform_map",
    "SELECT c_custkey AS id_municipio, c_name AS nome_municipio, upper(left(c_mktsegment, 2)) AS sigla_uf FROM customer",
)
def conform_map(spark, sf_dir):
    """Customers as municipalities, their segments as states."""
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id_municipio"),
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("nome_municipio"),
        F.concat(F.lit(" "), F.lower(F.left("c_mktsegment", F.lit(2)))).alias("sigla_uf"),
    )
    return op.conform(raw, PACK["mapeamento_municipio"])


# Joins


@query(
    "join_left_lookup",
    over_entities(
        """SELECT id_aluno, ano, id_escola, s.id_municipio, nome_municipio, sigla_uf
        FROM student s LEFT JOIN place p ON s.id_municipio = p.id_municipio"""
    ),
)
def join_left_lookup(spark, sf_dir):
    rows = students(spark, sf_dir).select("id_aluno", "ano", "id_escola", "id_municipio")
    places = op.conform(raw_map(spark, sf_dir), PACK["mapeamento_municipio"])
    return op.lookup_join(rows, places, "id_municipio")


@query(
    "join_left_multikey",
    over_entities(
        """SELECT id_aluno, id_escola, s.ano, s.id_municipio, s.rede, media_portugues
        FROM student s LEFT JOIN municipio m ON s.ano = m.ano AND s.id_municipio = m.id_municipio AND s.rede = m.rede"""
    ),
)
def join_left_multikey(spark, sf_dir):
    keys = PACK["municipio"].key
    rows = students(spark, sf_dir).select("id_aluno", "id_escola", *keys)
    indicators = conformed(spark, sf_dir, "municipio")["municipio"]
    return op.lookup_join(rows, indicators.select(*keys, "media_portugues"), keys)


@query(
    "join_inner_fanout",
    over_entities(
        """SELECT t.ano, t.id_municipio, t.meta_2024, m.rede, m.taxa_alfabetizacao
        FROM meta_municipio t JOIN municipio m ON t.ano = m.ano AND t.id_municipio = m.id_municipio"""
    ),
)
def join_inner_fanout(spark, sf_dir):
    target, actual = conformed(spark, sf_dir, "meta_municipio", "municipio").values()
    keys = ("ano", "id_municipio")
    actual = actual.select(*keys, "rede", "taxa_alfabetizacao")
    return op.lookup_join(target.select(*keys, "meta_2024"), actual, keys, how="inner")


@query(
    "join_same_name_columns",
    over_entities(
        """SELECT d.ano, d.id_municipio, d.rede, d.taxa_alfabetizacao AS taxa_municipio,
          u.taxa_alfabetizacao AS taxa_estado, u.media_portugues AS media_estado
        FROM dim_area d JOIN uf u ON d.ano = u.ano AND d.sigla_uf = u.sigla_uf AND d.rede = u.rede"""
    ),
)
def join_same_name_columns(spark, sf_dir):
    tables = conformed(spark, sf_dir, "municipio", "uf", "mapeamento_municipio")
    keys = ("ano", "sigla_uf", "rede")
    area = plans.area_dimension(tables).withColumnRenamed("taxa_alfabetizacao", "taxa_municipio")
    state = tables["uf"].select(
        *keys, F.col("taxa_alfabetizacao").alias("taxa_estado"), F.col("media_portugues").alias("media_estado")
    )
    joined = op.lookup_join(area.drop("media_portugues"), state, keys, how="inner")
    return joined.select("ano", "id_municipio", "rede", "taxa_municipio", "taxa_estado", "media_estado")


@query(
    "select_by_prefix",
    over_entities(f"SELECT ano, id_municipio, rede, {each('pc_nivel_{v}', LEVELS)} FROM municipio"),
)
def select_by_prefix(spark, sf_dir):
    town = conformed(spark, sf_dir, "municipio")["municipio"]
    return op.select_by_prefix(town, ("ano", "id_municipio", "rede"), SHARE_PREFIX)


# Aggregates and windows

SCHOOL = ("ano", "id_escola", "rede")


def _per_school(spark, sf_dir, **aggregates):
    return students(spark, sf_dir).groupBy(*SCHOOL).agg(*(c.alias(k) for k, c in aggregates.items()))


def _per_school_sql(columns: str) -> str:
    return over_entities(f"SELECT ano, id_escola, rede, {columns} FROM student GROUP BY ano, id_escola, rede")


@query(
    "agg_count_if",
    _per_school_sql(
        "count_if(compareceu)::BIGINT AS came, count_if(compareceu AND alfabetizado)::BIGINT AS literate"
    ),
)
def agg_count_if(spark, sf_dir):
    came = F.col("compareceu")
    return _per_school(
        spark, sf_dir, came=LF.count_where(came), literate=LF.count_where(came & F.col("alfabetizado"))
    )


@query(
    "agg_ratio_pct",
    _per_school_sql(half_up("count_if(NOT compareceu) / CAST(count(id_aluno) AS DOUBLE) * 100") + " AS absent_pct"),
)
def agg_ratio_pct(spark, sf_dir):
    absent = LF.percent(LF.count_where(~F.col("compareceu")), F.count("id_aluno"))
    return _per_school(spark, sf_dir, absent_pct=absent)


@query("agg_conditional_mean", _per_school_sql(half_up("avg(proficiencia) FILTER (compareceu)") + " AS mean_score"))
def agg_conditional_mean(spark, sf_dir):
    mean = LF.mean_where(F.col("compareceu"), F.col("proficiencia"))
    return _per_school(spark, sf_dir, mean_score=LF.half_up(mean))


@query(
    "agg_conditional_stddev",
    _per_school_sql(f"coalesce({half_up('stddev_samp(proficiencia) FILTER (compareceu)')}, 0) AS stddev_score"),
)
def agg_conditional_stddev(spark, sf_dir):
    spread = LF.stddev_where(F.col("compareceu"), F.col("proficiencia"))
    return _per_school(spark, sf_dir, stddev_score=LF.fill_number(LF.half_up(spread), 0))


@query(
    "agg_guarded_ratio",
    _per_school_sql(
        "coalesce("
        + half_up("count_if(compareceu AND alfabetizado) / CAST(nullif(count_if(compareceu), 0) AS DOUBLE) * 100")
        + ", 0) AS literate_pct"
    ),
)
def agg_guarded_ratio(spark, sf_dir):
    came = F.col("compareceu")
    share = LF.percent_or_zero(LF.count_where(came & F.col("alfabetizado")), LF.count_where(came))
    return _per_school(spark, sf_dir, literate_pct=share)


@query(
    "window_share_of_total",
    over_entities(
        f"""SELECT *, {half_up('students / CAST(sum(students) OVER (PARTITION BY ano, id_escola) AS DOUBLE) * 100')} AS share
        FROM (SELECT ano, id_escola, nivel_alfabetizacao, count(id_aluno) AS students FROM student GROUP BY ALL)"""
    ),
)
def window_share_of_total(spark, sf_dir):
    return op.share_of_total(
        students(spark, sf_dir), ("ano", "id_escola"), "nivel_alfabetizacao", "id_aluno", "students", "share"
    )


@query(
    "window_group_mean",
    over_entities(
        f"""SELECT id_aluno, ano, id_escola, proficiencia,
          {half_up('avg(proficiencia) OVER (PARTITION BY ano, id_escola)')} AS school_mean FROM student"""
    ),
)
def window_group_mean(spark, sf_dir):
    rows = students(spark, sf_dir).select("id_aluno", "ano", "id_escola", "proficiencia")
    return op.with_group_mean(rows, ("ano", "id_escola"), "proficiencia", "school_mean")


# Quality rules and duplicates


def _report_sql(source: str, rules: list[tuple[str, str | None, str, str]]) -> str:
    rows = " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS rule_no, '{kind}' AS kind,
          {f"'{column}'" if column else "CAST(NULL AS VARCHAR)"} AS column_name,
          CAST(({measured}) AS BIGINT) AS measured, {passed} AS passed FROM {source}"""
        for i, (kind, column, measured, passed) in enumerate(rules)
    )
    return over_entities(rows)


def _nulls(c: str):
    return "not_null", c, f"count_if({c} IS NULL)", f"count_if({c} IS NULL) = 0"


def _outside(c: str, low: float, high: float):
    measured = f"count_if({c} < {low} OR {c} > {high})"
    return "range", c, measured, f"{measured} = 0"


def _enough(n: int):
    return "min_count", None, "count(*)", f"count(*) >= {n}"


def _surplus(c: str):
    measured = f"count(*) - count(DISTINCT {c}) - max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
    return "unique", c, measured, f"{measured} = 0"


@query("dq_not_null", _report_sql("raw_student", [_nulls("id_aluno"), _nulls("proficiencia")]))
def dq_not_null(spark, sf_dir):
    rules = [Rule("not_null", c) for c in ("id_aluno", "proficiencia")]
    return op.quality_report(raw_students(spark, sf_dir), rules)


@query("dq_min_count", _report_sql("raw_student", [_enough(1), _enough(10**15)]))
def dq_min_count(spark, sf_dir):
    rules = [Rule("min_count", minimum=n) for n in (1, 10**15)]
    return op.quality_report(raw_students(spark, sf_dir), rules)


@query("dq_unique", _report_sql("(SELECT o_orderkey, nullif(o_custkey, 1) AS o_custkey FROM orders)", [_surplus("o_orderkey"), _surplus("o_custkey")]))
def dq_unique(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(1)).alias("o_custkey"))
    return op.quality_report(orders, [Rule("unique", "o_orderkey"), Rule("unique", "o_custkey")])


@query("dq_range", _report_sql("raw_student", [_outside("proficiencia", 605, 850), _outside("proficiencia", 650, 800)]))
def dq_range(spark, sf_dir):
    rules = [Rule("range", "proficiencia", bounds=b) for b in ((605, 850), (650, 800))]
    return op.quality_report(raw_students(spark, sf_dir), rules)


@query(
    "dq_report",
    _report_sql(
        "fct_student",
        [
            _enough(1),
            *(_nulls(c) for c in ("id_aluno", "ano", "id_escola")),
            *(_outside(c, 0, 1000) for c in ("proficiencia", "media_portugues_municipio", "media_portugues_estado")),
            _outside("nivel_alfabetizacao", 0, 8),
            _surplus("id_aluno"),
        ],
    ),
)
def dq_report(spark, sf_dir):
    """The rules of the student fact, and a unique rule that fails: an id comes back in other years.

    All but the unique rule are counted as the fact is staged; that one reads its column of the staged table.
    """
    fact = fact_student(spark, sf_dir)
    rules = (*FACT_RULES["fct_avaliacao_aluno"], Rule("unique", "id_aluno"))
    staged = sources.stage(fact, "student-fact", op.quality.counters(fact, rules))
    outcomes = op.evaluate({"fact": (staged, rules)})["fact"]
    rows = [(i, o.rule.kind, o.rule.column, o.measured, o.passed) for i, o in enumerate(outcomes)]
    return spark.createDataFrame(rows, "rule_no int, kind string, column_name string, measured bigint, passed boolean")


@query(
    "duplicate_report",
    over_entities(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS table_name, count(*) AS total_rows, count(DISTINCT ({keys})) AS distinct_keys,
              count(*) - count(DISTINCT ({keys})) AS duplicates FROM {source}"""
            for name, keys, source in (
                ("avaliacao_aluno", "ano, id_aluno", "student"),
                ("municipio", "ano, id_municipio, rede", "municipio"),
            )
        )
    ),
)
def duplicate_report(spark, sf_dir):
    """What a silver run counts before it drops duplicates."""
    town = conformed(spark, sf_dir, "municipio")["municipio"]
    tables = {"avaliacao_aluno": students(spark, sf_dir), "municipio": town}
    found = {n: op.find_repeats(df, PACK[n].key) for n, df in tables.items()}
    rows = [(n, r.total_rows, r.distinct_keys, r.duplicates) for n, r in found.items()]
    return spark.createDataFrame(rows, "table_name string, total_rows bigint, distinct_keys bigint, duplicates bigint")


@query("dedup_by_key", over_entities("SELECT * FROM student_1"))
def dedup_by_key(spark, sf_dir):
    return op.dedup_by_key(students(spark, sf_dir), PACK["avaliacao_aluno"].key)


# Facts and marts


@query("fact_student", over_entities("SELECT * FROM fct_student"))
def fact_student(spark, sf_dir):
    names = ("avaliacao_aluno", "mapeamento_municipio", "municipio", "uf")
    return plans.student_fact(conformed(spark, sf_dir, *names))


@query("dim_area", over_entities("SELECT * FROM dim_area"))
def dim_area(spark, sf_dir):
    return plans.area_dimension(conformed(spark, sf_dir, "mapeamento_municipio", "municipio"))


@query("fact_area_targets", over_entities("SELECT * FROM fct_area"))
def fact_area_targets(spark, sf_dir):
    names = ("mapeamento_municipio", "municipio", "meta_municipio", "meta_uf")
    return plans.area_target_fact(conformed(spark, sf_dir, *names))


@query("fact_state_targets", over_entities("SELECT * FROM fct_state"))
def fact_state_targets(spark, sf_dir):
    return plans.state_target_fact(conformed(spark, sf_dir, "uf", "meta_uf", "meta_brasil"))


@query("mart_area_targets", over_entities("SELECT * FROM mart_area"))
def mart_area_targets(spark, sf_dir):
    return plans.area_targets(fact_area_targets(spark, sf_dir))


@query("mart_state_targets", over_entities("SELECT * FROM mart_state"))
def mart_state_targets(spark, sf_dir):
    return plans.state_targets(fact_state_targets(spark, sf_dir))


@query("mart_level_distribution", over_entities("SELECT * FROM mart_levels"))
def mart_level_distribution(spark, sf_dir):
    return plans.level_distribution(fact_student(spark, sf_dir))


@query("mart_school_stats", over_entities("SELECT * FROM mart_schools"))
def mart_school_stats(spark, sf_dir):
    return plans.school_statistics(fact_student(spark, sf_dir))


@query("features_student", over_entities("SELECT * FROM features"))
def features_student(spark, sf_dir):
    """The fact is staged, as gold reads it from silver; the features read it twice."""
    fact = sources.stage(fact_student(spark, sf_dir), "student-fact").df
    return plans.student_features(fact)


# Layer runs


@query(
    "lost_rows",
    over_entities(
        f"""SELECT 'fct_meta_municipio' AS table_name, reason, count(*) AS row_count FROM (
          SELECT CASE WHEN d.sigla_uf = '{NOT_FOUND}' THEN 'no state'
            WHEN NOT EXISTS (SELECT 1 FROM meta_uf u WHERE u.ano = d.ano AND u.sigla_uf = d.sigla_uf AND u.sigla_uf <> 'EU')
              THEN 'no state target'
            WHEN NOT EXISTS (SELECT 1 FROM meta_municipio t WHERE t.ano = d.ano AND t.id_municipio = d.id_municipio
              AND t.id_municipio <> 3) THEN 'no target' END AS reason FROM dim_area d)
        WHERE reason IS NOT NULL GROUP BY reason
        UNION ALL SELECT 'fct_meta_uf', 'no target', count(*) FROM uf WHERE sigla_uf = 'EU'"""
    ),
)
def lost_rows(spark, sf_dir):
    """Indicator rows that the target facts lose: places without a state, a state and a place without targets."""
    tables = conformed(spark, sf_dir, *(n for n in PACK if n != "avaliacao_aluno"))
    tables["meta_uf"] = tables["meta_uf"].where("sigla_uf <> 'EU'")
    tables["meta_municipio"] = tables["meta_municipio"].where("id_municipio <> 3")
    lost = plans.facts.LOST
    parts = [
        rows.where(F.col(lost).isNotNull()).groupBy(F.col(lost).alias("reason")).agg(F.count(F.lit(1)).alias("row_count"))
        for rows in (plans.area_target_rows(tables), plans.state_target_rows(tables))
    ]
    area, state = (p.select(F.lit(n).alias("table_name"), "*") for p, n in zip(parts, ("fct_meta_municipio", "fct_meta_uf")))
    return area.unionAll(state)


BRONZE_SOURCES = {
    "avaliacao_aluno": "raw_student",
    "meta_brasil": "raw_meta_brasil",
    "meta_municipio": "raw_meta_municipio",
    "meta_uf": "raw_meta_uf",
    "municipio": "raw_municipio",
    "uf": "raw_uf",
    "mapeamento_municipio": "raw_map",
}
TABLE_SOURCES = {
    "silver": {"fct_avaliacao_aluno": "fct_student", "fct_meta_municipio": "fct_area", "fct_meta_uf": "fct_state"},
    "gold": {
        "consolidado_municipio": "mart_area",
        "consolidado_uf": "mart_state",
        "distribuicao_niveis": "mart_levels",
        "estatisticas_escolares": "mart_schools",
        "ml_aluno": "features",
    },
}
UNMATCHED = {
    "fct_avaliacao_aluno": f"(SELECT count(*) FROM fct_student WHERE nome_municipio = '{NOT_FOUND}')",
    "fct_meta_municipio": f"(SELECT count(*) FROM dim_area WHERE nome_municipio = '{NOT_FOUND}')",
    "fct_meta_uf": "CAST(0 AS BIGINT)",
}

# Keys delivered twice in the first year, with a value that makes dedup keep the row without it.
SECOND_ROWS = {"municipio": ("serie", "3"), "meta_municipio": ("rede", "' ZZZ '")}
FIRST_YEAR = "ano = 2024"


def _delivered(entity: str) -> str:
    """SQL of what lands for an entity."""
    source = BRONZE_SOURCES[entity]
    if entity not in SECOND_ROWS:
        return f"(SELECT * FROM {source})"
    column, value = SECOND_ROWS[entity]
    return f"(SELECT * FROM {source} UNION ALL SELECT * REPLACE ({value} AS {column}) FROM {source} WHERE {FIRST_YEAR})"


def _run_report_sql() -> str:
    none = "CAST(NULL AS BIGINT)"

    def row(layer, name, status, source, duplicates=none, unmatched=none, unparsed=none, ragged=none):
        return f"""SELECT '{layer}' AS layer, '{name}' AS table_name, '{status}' AS status, count(*) AS row_count,
          {duplicates} AS duplicates, {unmatched} AS unmatched, {unparsed} AS unparsed, {ragged} AS ragged FROM {source}"""

    zero = "CAST(0 AS BIGINT)"
    rows = [row("bronze", n, "written", _delivered(n), unparsed=zero, ragged=zero) for n in BRONZE_SOURCES]
    for n in BRONZE_SOURCES:
        keys = ", ".join(PACK[n].key)
        rows.append(row("silver", n, "read", _delivered(n), f"count(*) - count(DISTINCT ({keys}))"))
    rows += [
        row(layer, n, "written", s, unmatched=UNMATCHED.get(n, none))
        for layer, tables in TABLE_SOURCES.items()
        for n, s in tables.items()
    ]
    return over_entities(" UNION ALL ".join(rows))


def land_entities(spark: SparkSession, sf_dir: str) -> plans.Layout:
    """Write the raw entities as CSV landing folders, and name the folders of the layers above."""
    root = fresh_path(spark, "layers")
    layout = plans.Layout(*(f"{root}/{layer}" for layer in ("landing", "bronze", "silver", "gold")))
    raw = raw_entities(spark, sf_dir)
    for name, (column, value) in SECOND_ROWS.items():
        raw[name] = raw[name].unionAll(raw[name].where(FIRST_YEAR).withColumn(column, F.expr(value)))
    side_by_side(lambda name: _land(raw[name], f"{layout.landing}/{name}"), raw)
    return layout


def _all_layers(spark: SparkSession, sf_dir: str) -> tuple[plans.Layout, list[plans.TableRun]]:
    layout = land_entities(spark, sf_dir)
    runs = [
        *plans.run_bronze(spark, layout, STAMP, PACK),
        *plans.run_silver(spark, layout, STAMP, PACK),
        *plans.run_gold(spark, layout, STAMP),
    ]
    return layout, runs


@query("run_report", _run_report_sql())
def run_report(spark, sf_dir):
    """All three layers, from CSV files to marts."""
    return plans.report_frame(spark, _all_layers(spark, sf_dir)[1]).drop("message")


_LAYERS: dict[tuple[str, str], plans.Layout] = {}


def written_layers(spark: SparkSession, sf_dir: str) -> plans.Layout:
    """The folders of layers that all three runs have written, once for an application and its tables."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _LAYERS:
        _LAYERS[at] = _all_layers(spark, sf_dir)[0]
    return _LAYERS[at]


SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}
STAMPED = "CAST(epoch(TIMESTAMP '2026-07-14 12:30:45') AS BIGINT)"


def _stored_bronze_sql(entity: str) -> str:
    """CSV files hold text without the blanks around it."""
    columns = ", ".join(
        f"CAST({c} AS {SQL_TYPES[t]}) AS {c}" if t in SQL_TYPES else f"trim({c}) AS {c}"
        for c, t in PACK[entity].raw_types.items()
    )
    return over_entities(
        f"""SELECT {columns}, '{entity}' AS _source_entity, '20260714_123045' AS _ingestion_timestamp,
        '2026-07-14' AS _ingestion_date, CAST(2026 AS INTEGER) AS _ing_ano, CAST(7 AS INTEGER) AS _ing_mes, 'run' AS _batch,
        64 AS hash_length FROM {_delivered(entity)}"""
    )


def _stored_bronze(entity: str) -> Query:
    def run(spark, sf_dir):
        bronze = sources.read_partition(spark, f"{written_layers(spark, sf_dir).bronze}/{entity}", _ing_ano=2026, _ing_mes=7)
        return bronze.withColumn("hash_length", F.length("_record_hash")).drop("_record_hash", "_source_file", "_unparsed", "_ragged")

    return run


def _stored(layer: str, name: str, time: str, **month: int) -> Query:
    def run(spark, sf_dir):
        root = f"{getattr(written_layers(spark, sf_dir), layer)}/{name}"
        stored = sources.read_partition(spark, root, **month) if month else sources.read_table(spark, root)
        return stored.withColumn(time, F.unix_timestamp(time))

    return run


for _name in PACK:
    query(f"stored_bronze_{_name}", _stored_bronze_sql(_name))(_stored_bronze(_name))
for _name, _source in TABLE_SOURCES["silver"].items():
    _placed = f"{STAMPED} AS _silver_processed_at, CAST(2026 AS INTEGER) AS _proc_ano, CAST(7 AS INTEGER) AS _proc_mes"
    query(f"stored_silver_{_name}", over_entities(f"SELECT *, {_placed} FROM {_source}"))(
        _stored("silver", _name, "_silver_processed_at", _proc_ano=2026, _proc_mes=7)
    )
for _name, _source in TABLE_SOURCES["gold"].items():
    query(f"stored_gold_{_name}", over_entities(f"SELECT *, {STAMPED} AS _gold_processed_at FROM {_source}"))(
        _stored("gold", _name, "_gold_processed_at")
    )


@query(
    "bronze_batch_and_stream",
    f"SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'run' ELSE 'stream-0' END AS batch, 2 AS batches FROM ({ORDERS_SQL})",
)
def bronze_batch_and_stream(spark, sf_dir):
    """Half of the orders land by a run, half by a stream, in one bronze table; then its month is compacted."""
    root = fresh_path(spark, "both")
    orders = _orders(spark, sf_dir)
    even = F.col("o_orderkey") % 2 == 0
    _land(orders.where(even), f"{root}/landing/orders")
    _land(orders.where(~even), f"{root}/arriving")
    plans.run_bronze(spark, plans.Layout(f"{root}/landing", f"{root}/bronze", "", ""), STAMP, {"orders": ORDER})
    target = f"{root}/bronze/orders"
    ingest_new_files(spark, f"{root}/arriving", target, f"{root}/progress", ORDER, clock=lambda: STAMP).awaitTermination()
    before = sources.stage(sources.read_partition(spark, target, _ing_ano=2026, _ing_mes=7), "before").df
    batches = compact_month(spark, target, STAMP)
    after = sources.read_partition(spark, target, _ing_ano=2026, _ing_mes=7)
    batch = before.select("o_orderkey", F.col("_batch").alias("batch"))
    joined = after.select(*ORDER.raw_types).join(batch, "o_orderkey")
    return joined.withColumn("batches", F.lit(batches))


@query("stream_bronze_increment", ORDERS_SQL)
def stream_bronze_increment(spark, sf_dir):
    """Orders land in two deliveries, open ones later; each is taken in by its own run of the stream."""
    root = fresh_path(spark, "stream")
    orders = _orders(spark, sf_dir)
    for delivery in (F.col("o_orderstatus") != "O", F.col("o_orderstatus") == "O"):
        _land(orders.where(delivery), f"{root}/landing")
        ingest_new_files(
            spark, f"{root}/landing", f"{root}/bronze", f"{root}/progress", ORDER, clock=lambda: STAMP
        ).awaitTermination()
    return sources.read_partition(spark, f"{root}/bronze", _ing_ano=2026, _ing_mes=7).select(*ORDER.raw_types)


def _orders_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders a month on: some are gone, some have another price, some are new."""
    orders, key = _orders(spark, sf_dir), F.col("o_orderkey")
    price = F.when(key % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    stayed = orders.where(key % 7 != 0).withColumn("o_totalprice", price)
    return stayed.unionAll(orders.where((key % 11 == 0) & (key > 0)).withColumn("o_orderkey", -key))


@query(
    "bronze_changes",
    """SELECT o_orderkey, CASE WHEN o_orderkey < 0 THEN 'new' WHEN o_orderkey % 7 = 0 THEN 'gone' ELSE 'changed' END AS change
      FROM (SELECT o_orderkey FROM orders UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey > 0)
      WHERE o_orderkey < 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0""",
)
def bronze_changes(spark, sf_dir):
    """Two months of orders land in bronze; their row hashes tell which keys are new, changed or gone."""
    root = fresh_path(spark, "months")
    target = f"{root}/bronze/orders"
    months = []
    for month, delivered in ((7, _orders(spark, sf_dir)), (8, _orders_later(spark, sf_dir))):
        _land(delivered, f"{root}/landing-{month}/orders")
        stamp = op.RunStamp(datetime(2026, month, 14, tzinfo=timezone.utc))
        plans.run_bronze(spark, plans.Layout(f"{root}/landing-{month}", f"{root}/bronze", "", ""), stamp, {"orders": ORDER})
        months.append(month)
    before, after = (sources.read_partition(spark, target, _ing_ano=2026, _ing_mes=m) for m in months)
    return op.changes(before, after, ("o_orderkey",))


@query(
    "stream_unique_over_batches",
    f"""SELECT o_orderkey, o_custkey, 'stream-0' AS batch, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS n_again
      FROM ({ORDERS_SQL}) WHERE o_orderkey % 2 = 0""",
)
def stream_unique_over_batches(spark, sf_dir):
    """The second delivery brings some keys of the first again: its batch fails, and the table holds the first one only."""
    root = fresh_path(spark, "again")
    orders, key = _orders(spark, sf_dir), F.col("o_orderkey")
    again = 0
    for delivery in (key % 2 == 0, key % 3 == 0):
        _land(orders.where(delivery), f"{root}/landing")
        try:
            ingest_new_files(
                spark, f"{root}/landing", f"{root}/bronze", f"{root}/progress", ORDER, clock=lambda: STAMP
            ).awaitTermination()
        except StreamingQueryException as failure:
            again = int(re.search(r"unique\(o_orderkey\) measured (\d+)", str(failure))[1])
    bronze = sources.read_partition(spark, f"{root}/bronze", _ing_ano=2026, _ing_mes=7)
    return bronze.select("o_orderkey", "o_custkey", F.col("_batch").alias("batch"), F.lit(again).cast("bigint").alias("n_again"))


@query(
    "stream_file_ledger",
    f"""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'stream-0' ELSE 'stream-1' END AS batch,
        (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS refused_rows FROM ({ORDERS_SQL})""",
)
def stream_file_ledger(spark, sf_dir):
    """The second delivery brings the first one's files under other names, beside new ones: they are taken once and reported."""
    root = fresh_path(spark, "twice")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders, even = _orders(spark, sf_dir).repartition(files, "o_orderkey"), F.col("o_orderkey") % 2 == 0
    for deliveries in ([even], [even, ~even]):
        for delivery in deliveries:
            _land(orders.where(delivery), f"{root}/landing")
        ingest_new_files(
            spark, f"{root}/landing", f"{root}/bronze", f"{root}/progress", ORDER, clock=lambda: STAMP
        ).awaitTermination()
    bronze = sources.read_partition(spark, f"{root}/bronze", _ing_ano=2026, _ing_mes=7)
    refused = read_ledger(spark, f"{root}/bronze").where(F.col("same_as").isNotNull()).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("refused_rows"))
    return bronze.select("o_orderkey", "o_custkey", F.col("_batch").alias("batch")).join(F.broadcast(refused))


def _added_months(mart: str) -> Query:
    def run(spark, sf_dir):
        """Two months bring half of the students each; each is added to what is kept of the one before, whose fact is gone by then."""
        root = fresh_path(spark, "added")
        layout = plans.Layout("", "", f"{root}/silver", f"{root}/gold")
        fact = sources.stage(fact_student(spark, sf_dir), "student-fact").df
        half = F.pmod(F.xxhash64("id_aluno"), F.lit(2))
        for i, month in enumerate((7, 8)):
            stamp = op.RunStamp(datetime(2026, month, 14, tzinfo=timezone.utc))
            placed = fact.where(half == i).withColumns(stamp.partition(*SILVER_PARTITION))
            sources.write_partitioned(placed, f"{layout.silver}/fct_avaliacao_aluno", SILVER_PARTITION, keep_others=False)
            plans.add_month(spark, layout, stamp)
        return sources.read_table(spark, f"{layout.gold}/{mart}").drop(GOLD_TIME)

    return run


for _name in ("distribuicao_niveis", "estatisticas_escolares"):
    query(f"added_months_{_name}", over_entities(f"SELECT * FROM {TABLE_SOURCES['gold'][_name]}"))(_added_months(_name))
