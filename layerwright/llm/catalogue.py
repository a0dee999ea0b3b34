"""The registered queries: each applies its operator to the whole of its table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, jaccard, langid, licenses, ordering, packing, perplexity, phrases, pieces, pii, prefixes, spans, substring, topk
from .shared import workers_ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup(docs, size=35).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Numbered rows and their words; a word is what the operators take it to be.
WORDS_SQL = r"""w AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS words FROM documents)"""

ORACLES["op1_substring"] = f"""
WITH {WORDS_SQL.format(text="coalesce(text, '')")},
windows AS MATERIALIZED (
  SELECT row, i, array_to_string(words[i : i + 34], ' ') AS passage
  FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
repeated AS (SELECT passage FROM windows GROUP BY passage HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT row, unnest(range(i, i + 35)) AS i FROM windows WHERE passage IN (SELECT passage FROM repeated)),
placed AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (row, i) GROUP BY row),
counted AS (SELECT row, count(*) AS n FROM gone GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (row) LEFT JOIN counted USING (row)
"""


@query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


ORACLES["op2_topk"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.decode(pieces.encode(docs, PIECE_MODEL).drop("text"), PIECE_MODEL)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _digest(base, every, kinds: tuple[str, ...], base_kinds: tuple[str, ...]) -> list:
    counts = [spans.count(base, k).alias(f"n_{k}") for k in base_kinds]
    return [*counts, F.sha2(spans.joined(base, kinds), 256).alias("base_sha256"), spans.joined(every, kinds).alias("spans")]


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_digest(F.col("base"), F.concat("base", "linked"), credentials.KINDS, credentials.BASE))


@query
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_shingles", "component_id")


FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op6_jaccard"] = f"""
WITH RECURSIVE {WORDS_SQL.format(text=FOLDED)},
shingles AS MATERIALIZED (
  SELECT DISTINCT row, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT row, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM w)),
sizes AS MATERIALIZED (SELECT row, count(*) AS n FROM shingles GROUP BY row),
shared AS (
  SELECT a.row AS a, b.row AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.row <> b.row
  GROUP BY a.row, b.row),
links AS MATERIALIZED (
  SELECT a, b FROM shared s JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b
  WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
reached AS (SELECT row AS a, row AS b FROM w UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a AS row, min(doc_id) AS component_id FROM reached JOIN w ON w.row = b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM w LEFT JOIN sizes USING (row) JOIN least USING (row)
"""


@query
def op7_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = ordering.materialise(table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return ordering.read_shards(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *_digest(base, F.col("spans"), pii.KINDS, pii.BASE))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexity.assess(docs, drop_text=True).select("doc_id", "quality.*")


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(rest == 2, F.lit(False)).alias("held_out"))
    model = langid.learn(docs.where(~F.col("held_out")), PIECE_MODEL)
    found = langid.predict(docs.select("doc_id", "held_out", "text"), model, PIECE_MODEL)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLES["op11_phrases"] = f"""
WITH p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({FOLDED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (
  SELECT lang, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS a FROM (
    SELECT lang, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) s(k)))
  GROUP BY lang, phrase),
candidates AS MATERIALIZED (SELECT * FROM f WHERE a >= 10 AND len(g) > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, k, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.g[: k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.g[k + 1 :], ' ')),
least AS (
  SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(g[i : i + 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT lang, g, a, unnest([1, 2]) AS i FROM candidates WHERE len(g) = 3) GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM least s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE o.longest IS NULL OR 100 * o.longest < 50 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.turns_of(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    most = F.crc32(conv.cast("string").cast("binary")) % 4
    return prefixes.trie(prefixes.with_beginnings(turns, conv - conv % 20, most, 3))


#: CRC-32 of ASCII text, bit by bit: a character goes in by exclusive or, and eight shifts (-1) follow it.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295],
    flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split({}, '')])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""
_SAID = "coalesce(role, '') AS role, coalesce(text, '') AS text"
ORACLES["op12_trie"] = f"""
WITH t AS MATERIALIZED (
  SELECT conv_id, {_SAID}, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS b, {_CRC32.format('conv_id::VARCHAR')} % 4 AS h FROM t),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.b AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
placed AS MATERIALIZED (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d FROM rebuilt),
member AS MATERIALIZED (
  SELECT p.conv_id, p.d, any_value(p.text) AS text, md5(string_agg(md5(q.role) || md5(q.text), '' ORDER BY q.d)) AS node
  FROM placed p JOIN placed q ON q.conv_id = p.conv_id AND q.d <= p.d GROUP BY p.conv_id, p.d
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
node AS MATERIALIZED (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words
  FROM member GROUP BY d, node),
step AS MATERIALIZED (
  SELECT DISTINCT a.d, a.node, b.node AS child FROM member a JOIN member b ON b.conv_id = a.conv_id AND b.d = a.d + 1),
below AS MATERIALIZED (
  SELECT DISTINCT a.d, a.node, b.d AS low_d, b.node AS low FROM member a JOIN member b ON b.conv_id = a.conv_id AND b.d >= a.d),
children AS (SELECT d, node, count(*) AS n FROM step GROUP BY d, node),
sums AS (
  SELECT s.d, s.node, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM below s JOIN node n ON n.d = low_d AND n.node = low LEFT JOIN children k ON k.d = low_d AND k.node = low GROUP BY s.d, s.node),
last AS (SELECT conv_id, max(d) AS d FROM member GROUP BY conv_id),
ends AS (
  SELECT d, node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS hash FROM member JOIN last USING (conv_id, d) GROUP BY d, node)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(hash, sha256('')) AS ends_sha256
FROM node n JOIN sums s USING (d, node) LEFT JOIN children k USING (d, node) LEFT JOIN ends e USING (d, node)
LEFT JOIN step u ON u.d = n.d - 1 AND u.child = n.node LEFT JOIN node p ON p.d = u.d AND p.node = u.node
"""


@query
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_QUOTED = [(label, text.lower().replace("'", "''")) for label, some in licenses.TEMPLATES.items() for text in some]
_TEMPLATES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(_QUOTED))
_PHRASES = ", ".join(f"(['{"', '".join(phrase.split())}'], '{label}')" for phrase, label in licenses.PHRASES.items())
_SHINGLES = "array_to_string(w[i : i + 4], ' ') AS shingle"
ORACLES["op13_licenses"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {FOLDED} AS t FROM documents),
all_words AS MATERIALIZED (SELECT row, doc_id, {_WORDS.format("t")} AS w FROM d),
placed AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM all_words),
base AS (
  SELECT row, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_sort(list(DISTINCT label)) AS labels
  FROM placed JOIN (VALUES {_PHRASES}) p(phrase, label) ON w[i : i + len(phrase) - 1] = phrase GROUP BY row),
lines AS (
  SELECT row, i, {_WORDS.format("l[i]")} AS w FROM (SELECT row, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT row, string_split(t, chr(10)) AS l FROM d))),
marked AS (SELECT *, sum((len(w) = 0)::INT) OVER (PARTITION BY row ORDER BY i) AS block FROM lines),
blocks AS (SELECT row, block, flatten(list(w ORDER BY i)) AS w FROM marked WHERE len(w) > 0 GROUP BY row, block),
shingles AS (SELECT DISTINCT row, block, {_SHINGLES} FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM blocks)),
templates AS (
  SELECT DISTINCT id, label, {_SHINGLES} FROM (
    SELECT *, unnest(range(1, len(w) - 3)) AS i FROM (SELECT id, label, {_WORDS.format("t")} AS w FROM (VALUES {_TEMPLATES}) v(id, label, t)))),
sizes AS (SELECT id, count(*) AS size FROM templates GROUP BY id),
matched AS (
  SELECT row, label, count(*) / any_value(size) AS share FROM shingles JOIN templates USING (shingle) JOIN sizes USING (id)
  GROUP BY row, block, id, label HAVING 100 * count(*) >= {licenses.CONTAINED} * any_value(size)),
found AS (SELECT row, list(DISTINCT label) AS labels, max(share) AS share FROM matched GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
  greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN {licenses.NAMED} ELSE 0.0 END)::DOUBLE AS score
FROM all_words LEFT JOIN base b USING (row) LEFT JOIN found f USING (row)
"""
