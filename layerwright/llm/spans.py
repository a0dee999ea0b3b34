"""Spans of regular expression matches as column expressions: code points, end exclusive.

A match list and the list of texts between the matches come from built-in functions; lengths add up to
positions. Patterns must not match the empty text. Repeated groups at a pattern's end are possessive and
starts inside a run of the pattern's own first characters are skipped, so the search is linear in the text.
With n matches the rest takes n log n steps: nothing is appended to match by match, and a text is cut by blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters around a span that its context holds.
CONTEXT = 48
#: Characters of the blocks by which a text is cut.
BLOCK = 1024


def no_spans() -> Column:
    return F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT, found: STRING, before: STRING, after: STRING>>)")


def run_start(characters: str) -> str:
    """Where a match may start: at a run's first character or where the match before ended.

    From inside a run the pattern would read the same rest of the run, so it fails there if it failed at the start.
    """
    return rf"(?:\G|(?<![{characters}]))"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of numbers, ``both`` over all elements up to it.

    Each step takes in the element twice as far back as the step before, so n elements need log n passes.
    """
    steps = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(values))) - 1), lambda k: F.call_function("shiftleft", F.lit(1), k))

    def step(sums: Column, far: Column) -> Column:
        return F.transform(sums, lambda x, i: F.when(i >= far, both(x, F.get(sums, F.greatest(i - far, F.lit(0))))).otherwise(x))

    return F.aggregate(steps, values, step)


def matches(text: Column, kind: str, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """Leftmost non-overlapping matches as an array of structs, in order.

    ``before`` and ``after`` are the nearest characters up to the next match of the same kind. ``needs``: a text
    with none of these cannot match, which saves the search.
    """

    def placed(found: Column, gaps: Column) -> Column:
        moves = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda f, gap: (F.length(gap) + F.length(f)).cast("bigint"))

        def span(end: Column, i: Column) -> Column:
            match = F.get(found, i)
            return F.struct(
                F.lit(kind).alias("kind"),
                (end - F.length(match)).alias("start"),
                end.alias("end"),
                match.alias("found"),
                F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"),
            )

        return F.transform(bound(moves, lambda m: running(m, lambda x, y: x + y)), span)

    listed = bound(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, bound(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))).otherwise(no_spans()),
    )
    possible = F.lit(not needs)
    for n in needs:
        possible = possible | F.contains(text, F.lit(n))
    return F.when(possible, listed).otherwise(no_spans())


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    keyed = F.transform(
        spans,
        lambda s: F.struct(s["start"], place[s["kind"]].alias("place"), s["end"], s["kind"].alias("kind")),
    )
    text = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of the text that was cut into ``blocks``."""
    first = F.floor(start / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substring(near, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with each span, or chain of overlapping spans, replaced by the mark of its first kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))
    reach = lambda spans: running(F.transform(spans, lambda s: -s["minus_end"]), F.greatest)

    def joined_up(spans: Column, ends: Column, blocks: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("bigint"))
            return F.when(s["start"] >= at, F.concat(_between(blocks, at, s["start"]), mark(s["kind"]))).otherwise(F.lit(""))

        rest = _between(blocks, F.element_at(ends, -1), F.length(text).cast("bigint"))
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    put = bound(ordered, lambda o: bound(reach(o), lambda ends: bound(blocks, lambda b: joined_up(o, ends, b))))
    return F.when(F.size(spans) > 0, put).otherwise(text)
