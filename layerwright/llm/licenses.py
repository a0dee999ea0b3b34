"""Licenses in texts: phrases that name one, and an exact containment join of text blocks with license templates.

Words are runs of letters a-z (A-Z folded), digits and characters beyond ASCII. A block is a run of lines that hold words, between lines
that hold none; comment marks and wrapping do not matter. A template's tokens are its distinct shingles of ``SHINGLE``
words. A block contains a template if it has at least ``CONTAINED`` of the template's tokens.

The join finds every such pair. Tokens are ordered by their number in all blocks of the corpus, rarest first (ties by token). A
block that shares ``t`` of a template's ``m`` tokens has one of the first ``m - t + 1`` in that order, so only these are looked up; a
block with fewer than ``t`` tokens of any template is left out (length); and a token at place ``i`` of the template and ``p`` of the
block leaves at most the lesser rest of both to share (position). Candidates are verified by their tokens. Tokens that no template has
cannot be shared, so blocks drop them when they are read; the templates are fixed text, which bounds the tokens that are sent out.

A block's tokens travel once to be counted and once to be joined; a block is dealt by its row and number, so copies and crowded
tokens spread over all tasks.

Defined cases: null and empty texts have no words and no labels; a text of any length is read whole; rows that repeat, also with null ids, each
have a row; an empty table gives no rows; other columns but the text pass through, and a result name that clashes gets an underscore.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .shared import free_name, written

#: Words of a token, and the share of a template's tokens, in per cent, that a block must have.
SHINGLE, CONTAINED = 5, 75
#: Score of a text that only names a license.
NAMED = 0.5
#: Phrases that name a license, and its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Paragraphs of public licenses and of the notices that they ask for, by label.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF'
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE"
        " FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION"
        " WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
    ),
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language'
        " governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in"
        " the documentation and/or other materials provided with the distribution.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with"
        " this file, You can obtain one at",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}

_PLAIN = bytearray(b" " * 128 + bytes(range(128, 256)))
_PLAIN[48:58], _PLAIN[97:123], _PLAIN[65:91], _PLAIN[10] = bytes(range(48, 58)), bytes(range(97, 123)), bytes(range(97, 123)), 10
_PLAIN = bytes(_PLAIN)
BLOCKS = ArrayType(StructType([StructField("block", IntegerType()), StructField("tokens", ArrayType(IntegerType()))]))


def blocks_of(text: bytes) -> list[list[bytes]]:
    """The words of each block."""
    out: list[list[bytes]] = [[]]
    for line in text.translate(_PLAIN).split(b"\n"):
        if words := line.split():
            out[-1] += words
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def shingles(words: list[bytes]) -> set[str]:
    return {b" ".join(words[i : i + SHINGLE]).decode() for i in range(len(words) - SHINGLE + 1)}


class Templates:
    """The templates' tokens, numbered, and an automaton that finds them between spaces."""

    def __init__(self, texts: dict[str, tuple[str, ...]]):
        import ahocorasick

        sets = [(label, shingles([w for b in blocks_of(t.encode()) for w in b])) for label, some in texts.items() for t in some]
        if not all(s for _, s in sets):
            raise ValueError(f"a template needs {SHINGLE} words at least")
        numbers = {token: i for i, token in enumerate(sorted(set().union(*(s for _, s in sets))))}
        self.labels = [label for label, _ in sets]
        self.tokens = [sorted(numbers[x] for x in s) for _, s in sets]
        self.automaton = ahocorasick.Automaton()
        for token, i in numbers.items():
            self.automaton.add_word(f" {token} ", i)
        if numbers:
            self.automaton.make_automaton()

    def found(self, block: str) -> list[int]:
        """The distinct tokens in a block's words, which spaces divide and enclose."""
        return sorted({i for _, i in self.automaton.iter(block)}) if self.tokens else []


@functools.lru_cache(maxsize=4)
def _templates(items: tuple[tuple[str, tuple[str, ...]], ...]) -> Templates:
    return Templates(dict(items))


def named(words: bytes, phrases: dict[str, str]) -> tuple[int, int | None, int | None, list[str]]:
    """Places where a phrase's words stand in a row: how many, the first and last one's word, and the labels; ``words`` with a space around each."""
    places, labels = [], set()
    for phrase, label in phrases.items():
        inner = re.compile(b"(?= " + re.escape(phrase.encode()) + b" )")
        at = [m.start() for m in inner.finditer(words)] if phrase.encode() in words else []
        if at:
            labels.add(label)
            # The word at a place has as many spaces before it as words.
            cuts = [0, *at]
            counts = np.cumsum([words.count(b" ", a, b) for a, b in zip(cuts, cuts[1:], strict=False)])
            places += counts.tolist()
    return len(places), min(places, default=None), max(places, default=None), sorted(labels)


def scan(
    docs: DataFrame, text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES, contained: int = CONTAINED
) -> DataFrame:
    """The rows of ``docs`` without the text, with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``,
    ``score``, and ``matches``: block, template, label and the share of the template's tokens in the block."""
    items = tuple(templates.items())
    kept = docs.drop(text)
    raw, row = free_name(kept, "_raw"), free_name(kept, "_row")
    made = [("_words", LongType()), ("_base", LongType()), ("_first", LongType()), ("_last", LongType()), ("_labels", ArrayType(StringType())), ("_blocks", BLOCKS)]
    made = [(free_name(kept, n), kind) for n, kind in made]
    schema = StructType([*kept.schema.fields, *[StructField(n, kind) for n, kind in made]])
    kinds = [to_arrow_type(kind) for _, kind in made]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _templates(items)
        for batch in batches:
            out: list[list] = [[] for _ in made]
            for t in batch.column(batch.num_columns - 1):
                blocks = [b" ".join([b"", *words, b""]) for words in blocks_of(t.as_py() or b"")]
                whole = b"".join([b[:-1] for b in blocks]) + b" "
                tokens = [(i, found) for i, b in enumerate(blocks) if (found := known.found(b.decode()))]
                values = (whole.count(b" ") - 1, *named(whole, phrases), [{"block": i, "tokens": x} for i, x in tokens])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            arrays = [pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=schema.names)

    _templates(items)  # a template that is too short is an error here
    texts = docs.withColumn(raw, F.col(text).cast("string").cast("binary")).drop(text)
    rows = written(texts.mapInArrow(read, schema).withColumn(row, F.monotonically_increasing_id()), "read")
    words, base, first, last, labels, blocks = [n for n, _ in made]

    matched = _contained(rows.select(F.col(row).alias("row"), F.explode(blocks).alias("b")).select("row", "b.*"), _templates(items), contained)
    found = matched.groupBy(F.col("row").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("block", "template", "label", "share"))).alias("_matches"))
    joined = rows.join(found, rows[row] == F.col("_of"), "left")
    name = lambda wanted: free_name(kept, wanted)
    matches = F.coalesce("_matches", F.expr("CAST(array() AS ARRAY<STRUCT<block: INT, template: INT, label: STRING, share: DOUBLE>>)"))
    every = F.array_sort(F.array_distinct(F.concat(labels, F.transform(matches, lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform(matches, lambda m: m["share"])), F.lit(0.0))
    return joined.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        F.col(words).alias(name("n_words")),
        F.col(base).alias(name("n_base")),
        F.col(first).alias(name("first_word")),
        F.col(last).alias(name("last_word")),
        F.array_join(labels, ",").alias(name("base_labels")),
        F.array_join(every, ",").alias(name("labels")),
        F.greatest(best, F.when(F.col(base) > 0, F.lit(NAMED)).otherwise(F.lit(0.0))).alias(name("score")),
        matches.alias(name("matches")),
    )


def _contained(blocks: DataFrame, known: Templates, contained: int) -> DataFrame:
    """``row``, ``block``, ``template``, ``label`` and ``share`` of every block that holds a template; ``blocks`` has row, block and tokens."""
    spark = blocks.sparkSession
    counts = dict(blocks.select(F.explode("tokens").alias("token")).groupBy("token").count().collect())  # a row for each template token
    ranked = sorted({x for some in known.tokens for x in some}, key=lambda x: (counts.get(x, 0), x))
    rank = {token: i for i, token in enumerate(ranked)}
    table, prefix = [], []
    for i, some in enumerate(known.tokens):
        ordered = sorted(rank[x] for x in some)
        need = -(-contained * len(some) // 100) or 1
        table.append((i, known.labels[i], ordered, need))
        prefix += [(token, i, at, len(some), need) for at, token in enumerate(ordered[: len(some) - need + 1])]
    sent = spark.createDataFrame(table, "template int, label string, template_tokens array<int>, need int")
    heads = spark.createDataFrame(prefix, "token int, template int, at int, of int, need int")
    ranks = F.lit([rank[token] for token in range(len(rank))] or [0])
    ordered = blocks.select("row", "block", F.array_sort(F.transform("tokens", lambda t: ranks[t])).alias("tokens"))
    probes = ordered.select("row", "block", "tokens", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "token"))
    rest = F.least(F.col("of") - F.col("at"), F.col("size") - F.col("place"))
    candidates = probes.join(F.broadcast(heads), "token").where((F.col("size") >= F.col("need")) & (rest >= F.col("need")))
    # The first shared token of a pair has the lowest place; the others of the prefix name the same pair.
    pairs = candidates.groupBy("row", "block", "template").agg(F.first("tokens").alias("tokens"))
    shared = F.size(F.array_intersect("tokens", "template_tokens"))
    verified = pairs.join(F.broadcast(sent), "template").where(shared >= F.col("need"))
    return verified.select("row", "block", "template", "label", (shared / F.size("template_tokens")).alias("share"))
