"""Quality rules: counted together in one pass, then gated."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from layerwright.functions import count_where, parse
from layerwright.sources.landing import RAGGED, UNPARSED
from layerwright.sources.workspace import Staged
from layerwright.spec import Rule


class QualityError(Exception):
    """A table failed rules; ``outcomes`` holds those that failed."""

    def __init__(self, table: str, outcomes: list[Outcome]):
        self.table, self.outcomes = table, outcomes
        super().__init__(f"{table}: " + "; ".join(f"{o.rule} measured {o.measured}" for o in outcomes))


@dataclass(frozen=True)
class Outcome:
    """What a rule measured (None if its column is missing) and whether it passed."""

    rule: Rule
    measured: int | None

    @property
    def passed(self) -> bool:
        if self.measured is None:
            return False
        return self.measured >= self.rule.minimum if self.rule.kind == "min_count" else self.measured == 0


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> Column:
    """Outside the inclusive bounds. NULL is not outside; NaN is above every number."""
    have = df.schema[column].dataType
    c = F.col(column) if isinstance(have, NumericType) else parse(F.col(column), have, "double")
    return (c < low) | (c > high)


def _sound(df: DataFrame) -> Column:
    """Rows of whole lines: the values of a ragged line are not known, so no rule on a column counts it."""
    return F.col(RAGGED).isNull() if RAGGED in df.columns else F.lit(True)


def _counter(df: DataFrame, rule: Rule) -> Column:
    """The aggregate that measures a rule other than unique; NULL if its column is missing."""
    if rule.kind == "min_count":
        return F.count(F.lit(1))
    if rule.kind == "width":
        return count_where(F.col(RAGGED).isNotNull()) if RAGGED in df.columns else F.lit(None).cast("bigint")
    if rule.column not in df.columns or (rule.kind == "parsed" and UNPARSED not in df.columns):
        return F.lit(None).cast("bigint")
    if rule.kind == "parsed":
        return count_where(F.coalesce(F.map_contains_key(UNPARSED, rule.column), F.lit(False)))
    if rule.kind == "not_null":
        return count_where(F.col(rule.column).isNull() & _sound(df))
    if rule.kind == "range":
        return count_where(out_of_range(df, rule.column, *rule.bounds))
    raise ValueError(f"unknown rule kind {rule.kind!r}")


def _needs_own_scan(df: DataFrame, rule: Rule) -> bool:
    return rule.kind == "unique" and rule.column in df.columns


def counters(df: DataFrame, rules: Iterable[Rule]) -> dict[str, Column]:
    """Aggregates of all rules but unique ones, by rule number; they can ride on a write."""
    return {
        f"_rule_{i}": _counter(df, r) for i, r in enumerate(rules) if not _needs_own_scan(df, r)
    }


def surplus_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows minus distinct values of a column, NULL being one value. Reads that column only, and
    each task sends one row per value it saw."""
    per_value = df.where(_sound(df)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("measured"))


def _measurement(number: int, rule: Rule, measured: str) -> Column:
    return F.struct(
        F.lit(number).alias("rule_no"),
        F.lit(rule.kind).alias("kind"),
        F.lit(rule.column).cast("string").alias("column_name"),
        F.lit(rule.minimum or 0).cast("bigint").alias("bound"),
        F.col(measured).alias("measured"),
    )


def _measurements(df: DataFrame, rules: tuple[Rule, ...], counted: bool = False) -> DataFrame | None:
    """A row per rule: one scan for all rules but unique ones, and one narrow scan for each of
    those. ``counted`` leaves out the rules that the first scan would serve."""
    parts = []
    wanted = {} if counted else counters(df, rules)
    if wanted:
        row = df.agg(*(c.alias(k) for k, c in wanted.items()))
        cells = [_measurement(i, r, f"_rule_{i}") for i, r in enumerate(rules) if f"_rule_{i}" in wanted]
        parts.append(row.select(F.inline(F.array(*cells))))
    parts += [
        surplus_rows(df, r.column).select(F.inline(F.array(_measurement(i, r, "measured"))))
        for i, r in enumerate(rules)
        if _needs_own_scan(df, r)
    ]
    return reduce(DataFrame.unionAll, parts) if parts else None


def quality_report(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One row per rule: number, kind, column, what it measured and whether it passed.

    A rule on a missing column does not pass and measures NULL.
    """
    measured = F.col("measured")
    enough = F.when(F.col("kind") == "min_count", measured >= F.col("bound")).otherwise(measured == 0)
    return _measurements(df, tuple(rules)).select(
        "rule_no", "kind", "column_name", "measured", F.coalesce(enough, F.lit(False)).alias("passed")
    )


def evaluate(tables: dict[str, tuple[DataFrame | Staged, Iterable[Rule]]]) -> dict[str, list[Outcome]]:
    """Outcomes of the rules of several tables, counted in one job.

    The driver receives one number per rule. A staged table brings the counts taken as it was
    written, so only its unique rules read it again.
    """
    known: dict[tuple[str, int], int] = {}
    pending = []
    for name, (table, rules) in tables.items():
        staged = isinstance(table, Staged)
        if staged:
            known |= {
                (name, int(k.removeprefix("_rule_"))): v
                for k, v in table.metrics.items()
                if k.startswith("_rule_")
            }
        rows = _measurements(table.df if staged else table, tuple(rules), counted=staged)
        if rows is not None:
            pending.append(rows.select(F.lit(name).alias("table"), "rule_no", "measured"))
    if pending:
        found = reduce(DataFrame.unionAll, pending).collect()
        known |= {(r["table"], r["rule_no"]): r["measured"] for r in found}
    return {
        name: [Outcome(r, known.get((name, i))) for i, r in enumerate(rules)]
        for name, (_, rules) in tables.items()
    }


def gate(outcomes: dict[str, list[Outcome]]) -> None:
    """Raise if any rule of any table failed."""
    for name, results in outcomes.items():
        failed = [o for o in results if not o.passed]
        if failed:
            raise QualityError(name, failed)
