"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

A span's score is its kind's prior, plus ``CHECKED`` where a checksum or range confirms it, plus ``NEARBY`` where
a word that announces the kind stands within the context. Spans of the base kinds stay at any score;
the others (account numbers confirmed by mod 97, and number groups that only their context makes
personal) stay from ``ENOUGH`` on. All of it is column expressions on the row, without a shuffle.

Defined cases: a null text counts as empty and has no spans; the same rows give the same spans; spans of
different kinds may overlap; other columns pass through and a clashing result name gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as sp
from .shared import free_name

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
PRIOR = {"email": 0.6, "ip": 0.4, "card": 0.3, "phone": 0.4, "iban": 0.3, "ssn": 0.3}
CHECKED, NEARBY, ENOUGH = 0.3, 0.3, 0.6

#: Characters of an account number after its country's code and two digits, from the register of account number formats.
IBAN_REST = {
    11: "NO", 12: "BE", 14: "DK FK FO FI GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH HR LI LV",
    18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG",
    21: "LY PT ST", 22: "IS TR", 23: "BI DJ FR GR IT MC MR SM", 24: "AL AZ BY CY DO GT HN HU LB NI PL SV", 25: "BR EG PS QA UA",
    26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}
LOCAL = "A-Za-z0-9._%+-"
#: Same matches as the stated base patterns; see ``spans.run_start`` for the starts that are skipped.
PATTERNS = {
    "email": sp.run_start(LOCAL) + rf"[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": sp.run_start("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # As long as the country has it, so what follows after a space does not count; codes outside the register have any length.
    # The first lookahead says what all countries share, so that their list is gone through only there.
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"
    + "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}+" for n, names in IBAN_REST.items())
    + rf"|(?!(?:{'|'.join(IBAN_REST.values()).replace(' ', '|')}))[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
NEEDS = {"email": ("@",), "ip": (".",), "phone": ("+",), "ssn": ("-",)}
#: Words, in lower case, that announce a kind.
WORDS = {
    "email": "mail|contact|write to|correo|schreib|courriel",
    "ip": r"\bip\b|address|host|server|login",
    "card": "card|visa|mastercard|credit|payment|carte|karte|tarjeta",
    "phone": r"phone|\btel|call|mobile|fax|whatsapp|telefon|llam",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer|passport|sozialversicherung|identit|identidad",
}


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _sound_ip(s: Column) -> Column:
    significant = lambda part: F.regexp_replace(part, "^0+(?=.)", "")
    low = lambda part: (F.length(significant(part)) <= 3) & (significant(part).substr(1, 3).cast("int") <= 255)
    return F.forall(F.split(s["found"], r"\.", -1), low)


def _sound_card(s: Column) -> Column:
    digits = _digits(s["found"])
    return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)


def _mod_97(found: Column) -> Column:
    """Remainder of the number that an account number stands for: first four characters last, letters as 10 to 35."""
    plain = F.regexp_replace(found, " ", "")
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def _confirmed(s: Column, kind: str) -> Column:
    """Whether the checksum or range holds; null for kinds that have none."""
    if kind == "ip":
        return _sound_ip(s)
    if kind == "card":
        return _sound_card(s)
    if kind == "phone":
        return F.length(_digits(s["found"])).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(s["found"], " ", "")).between(15, 34) & (_mod_97(s["found"]) == 1)
    return F.lit(None).cast("boolean")


def _scored(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind, with their scores."""
    proposed = sp.matches(text, kind, PATTERNS[kind], NEEDS.get(kind, ()))
    checked = kind in ("ip", "card", "phone", "iban")
    if checked:
        proposed = F.filter(proposed, lambda s: _confirmed(s, kind))
    prior = PRIOR[kind] + CHECKED * checked

    def score(s: Column) -> Column:
        near = F.lower(F.concat(s["before"], F.lit(" "), s["after"])).rlike(WORDS[kind])
        return s.withField("score", F.when(near, F.lit(round(prior + NEARBY, 3))).otherwise(F.lit(round(prior, 3))))

    scored = F.transform(proposed, score)
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= ENOUGH)


def find(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Adds ``spans``: kind, start, end, found text, context before and after, and score of each span."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumn(free_name(df, spans), F.concat(*[_scored(content, k) for k in KINDS]))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each span of ``text`` replaced by its kind in capitals and brackets; a null text stays null."""
    name = free_name(df, "spans")
    found = find(df, text, name)
    marked = sp.replaced(F.col(text), F.col(name), lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    return found.withColumn(text, marked).drop(name)
