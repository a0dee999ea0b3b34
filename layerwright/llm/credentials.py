"""Secrets in texts, with credentials that come in parts linked by an interval join.

Base spans (assignments, access identifiers, hexadecimal runs) stand for themselves. Two more kinds are
too weak alone: ``opaque`` tokens that mix cases and digits, and ``endpoint`` addresses. Within a scope of
``REACH`` characters to either side in the same document, an opaque token is reported if an access
identifier or an endpoint is there, and an endpoint if both an access identifier and a secret of any kind are.

The join is on document and cell of ``REACH`` characters. A cell is summed up first by the first and last
position of each kind, which is enough to say how near the nearest part is, so the work is linear in the
number of spans and no pairs are made.

Defined cases: a null text counts as empty; rows are told apart by id and text hash, and rows equal in both have
equal spans, each keeping its own row; null ids are an id of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as sp
from .shared import text_key, written

BASE = ("assign", "access", "hex")
WEAK = ("opaque", "endpoint")
KINDS = (*BASE, *WEAK)
REACH = 400
VALUE = "A-Za-z0-9+/_.=-"
NAMED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"{NAMED}([{VALUE}]+)"
#: Same matches as the stated base patterns where the length rules hold.
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "opaque": rf"(?<![{VALUE}])[{VALUE}]{{20,}}+",
    "endpoint": r"(?:https?|ftp|jdbc:[a-z]{2,12}|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.:@-]{4,}+(?:/[A-Za-z0-9._~/-]*+)?",
}
NEEDS = {"assign": (":", "="), "access": ("AKIA",), "endpoint": ("://",)}


def _found(text: Column, kind: str) -> Column:
    found = sp.matches(text, kind, PATTERNS[kind], NEEDS.get(kind, ()))
    if kind == "assign":
        return F.filter(found, lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= 6)
    if kind == "opaque":  # not what a base span holds already
        mixed = lambda s: s["found"].rlike("[a-z]") & s["found"].rlike("[A-Z]") & s["found"].rlike("[0-9]")
        new = lambda s: ~s["before"].rlike(NAMED + "$") & ~s["found"].rlike(f"{NAMED}|{PATTERNS['access']}")
        return F.filter(found, lambda s: mixed(s) & new(s))
    return found


def _near(cells: DataFrame, rows: DataFrame, kinds: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` with ``name``: whether a part of one of ``kinds`` starts within ``REACH``."""
    parts = cells.where(F.col("kind").isin(*kinds)).groupBy("p_id", "p_key", "p_cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    probe = F.explode(F.expr("sequence(cell - 1, cell + 1)"))
    met = rows.withColumn("probe", probe).join(
        parts,
        F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("row_key") == F.col("p_key")) & (F.col("probe") == F.col("p_cell")),
        "left",
    )
    gap = F.when(F.col("probe") == F.col("cell"), F.lit(0)).when(F.col("probe") < F.col("cell"), F.col("start") - F.col("hi")).otherwise(F.col("lo") - F.col("start"))
    return met.groupBy(*rows.columns).agg(F.coalesce(F.max((gap <= REACH) & F.col("lo").isNotNull()), F.lit(False)).alias(name))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``df``: the id (as ``doc_id``), ``base`` and ``linked``: structs of kind, start, end, in no order."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"]))
    found = lambda kinds: F.concat(*[slim(_found(content, k)) for k in kinds])
    key = text_key(F.col(text).cast("string"))
    scanned = written(df.select(F.col(id_col).alias("doc_id"), key.alias("row_key"), found(BASE).alias("base"), found(WEAK).alias("weak")), "spans")

    paired = scanned.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).dropDuplicates(["doc_id", "row_key"])
    rows = paired.select("doc_id", "row_key", F.explode(F.concat("base", "weak")).alias("s")).select(
        "doc_id", "row_key", "s.*", (F.col("s.start") / REACH).cast("bigint").alias("cell")
    )
    cells = rows.groupBy(F.col("doc_id").alias("p_id"), F.col("row_key").alias("p_key"), F.col("cell").alias("p_cell"), "kind").agg(
        F.min("start").alias("lo"), F.max("start").alias("hi")
    )
    near = rows.where(F.col("kind").isin(*WEAK))
    for name, kinds in (("identified", ("access",)), ("addressed", ("endpoint",)), ("keyed", ("assign", "hex", "opaque"))):
        near = _near(cells, near, kinds, name)
    strong = F.when(F.col("kind") == "opaque", F.col("identified") | F.col("addressed")).otherwise(F.col("identified") & F.col("keyed"))
    linked = near.where(strong).groupBy(F.col("doc_id").alias("l_id"), F.col("row_key").alias("l_key")).agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("linked")
    )
    same = F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("row_key") == F.col("l_key"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT>>)")
    return scanned.join(linked, same, "left").select("doc_id", "base", F.coalesce("linked", none).alias("linked"))
