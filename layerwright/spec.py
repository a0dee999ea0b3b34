"""Declarations that operators compile into Spark expressions. Nothing here touches Spark."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class CodeList:
    """Code -> label; every other code, NULL included, gets ``other``."""

    labels: Mapping
    other: object


@dataclass(frozen=True)
class Field:
    """One conformed column: where it comes from and what happens to it, in this order:
    cast to ``dtype``, fill, text clean-up, round, then label or band."""

    name: str
    dtype: str
    source: str | None = None
    fill: float | None = None
    digits: int | None = None
    text: str | None = None
    codes: CodeList | None = None
    edges: tuple[float, ...] | None = None
    optional: bool = False

    @property
    def origin(self) -> str:
        return self.source or self.name


@dataclass(frozen=True)
class Rule:
    """A data-quality rule. ``kind`` is not_null, min_count, unique, range, parsed (no text of the
    column failed to take its declared type) or width (no line has another number of values than its header)."""

    kind: str
    column: str | None = None
    minimum: int | None = None
    bounds: tuple[float, float] | None = None

    def __str__(self) -> str:
        detail = {"min_count": self.minimum, "range": self.bounds}.get(self.kind)
        return f"{self.kind}({self.column or '*'}{'' if detail is None else f', {detail}'})"


def ruleset(
    required: tuple[str, ...] = (),
    unique: tuple[str, ...] = (),
    ranges: Mapping[tuple[float, float], tuple[str, ...]] | None = None,
    min_rows: int = 1,
) -> tuple[Rule, ...]:
    """The rules of one table: enough rows, then required, unique and bounded columns."""
    return (
        Rule("min_count", minimum=min_rows),
        *(Rule("not_null", c) for c in required),
        *(Rule("unique", c) for c in unique),
        *(Rule("range", c, bounds=b) for b, columns in (ranges or {}).items() for c in columns),
    )


@dataclass(frozen=True)
class Entity:
    """A landing entity: its business key, conformed fields and the rules of its raw rows."""

    name: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]
    rules: tuple[Rule, ...] = ()

    @property
    def raw_types(self) -> dict[str, str]:
        """Type of each raw column; 0/1 flags arrive as integers."""
        return {f.origin: "int" if f.dtype == "boolean" else f.dtype for f in self.fields}

    def parse_rules(self, columns: list[str]) -> tuple[Rule, ...]:
        """A rule for each of these raw columns whose text must become something else."""
        return tuple(Rule("parsed", c) for c, kind in self.raw_types.items() if kind != "string" and c in columns)
