"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

Every prefix of a text has one encoding, so one last token. The table stores that token for each
prefix: an automaton lists the vocabulary tokens that end at a position, and the right one is the one
whose predecessor, the last token of the prefix before it, forms a pair with it that the merges leave
alone. Walking the table backwards from the end gives the ids. The cost is linear in the text.

Texts are cut first where no vocabulary token can span the cut, so a token table is built per word and
kept for words that come again.

Defined cases: a null text is the empty text; the empty text is begin and end id only; a literal
U+2581 counts as a space, as in the library; characters outside the vocabulary become byte tokens.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

SPACE = "▁"
#: Words whose ids a worker keeps; when full, the table starts anew.
KEPT_WORDS = 250_000
NEVER = 1 << 60


class PieceModel:
    """Vocabulary and merge ranks of a BPE ``.model`` file with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = vocabulary.bos_id(), vocabulary.eos_id(), vocabulary.unk_id()
        size = vocabulary.get_piece_size()
        names = [vocabulary.id_to_piece(i) for i in range(size)]
        special = [vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_unused(i) for i in range(size)]
        byte = [vocabulary.is_byte(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i] and not byte[i]}
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(names) if byte[i]}
        self.surface = [
            b"" if special[i] else bytes([int(p[1:-1], 16)]) if byte[i] else p.replace(SPACE, " ").encode()
            for i, p in enumerate(names)
        ]
        scores = {p: vocabulary.get_score(i) for p, i in self.ids.items()}
        blank = {p for p in self.ids if not p.strip(SPACE)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or len({scores[p] for p in blank if len(p) > 1}) > 1:
            raise ValueError("a token spans words, or runs of spaces have merges of their own order")
        #: Merge order of tokens of two or more characters; runs of spaces are merged apart, last of all.
        merged = sorted((p for p in self.ids if len(p) > 1 and p not in blank), key=lambda p: -scores[p])
        if len({scores[p] for p in merged}) < len(merged):
            raise ValueError("two tokens share a rank")
        self.rank = {p: i for i, p in enumerate(merged)}
        self.blank = {len(p) for p in blank}
        self.left: dict[str, str] = {}
        self.right: dict[str, str] = {}
        self.joined = {a + b for p in merged for a, b in zip(p, p[1:], strict=False)}
        self.automaton = ahocorasick.Automaton()
        for p in merged:
            if (parts := self._last_merge(p)) is not None:
                self.left[p], self.right[p] = parts
                self.automaton.add_word(p, p)
        for c in {c for p in merged for c in p}:
            self.automaton.add_word(c, c)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two tokens that the merges join last into ``piece``; None where they never form it."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], NEVER))
            if parts[best] + parts[best + 1] not in self.rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def compatible(self, a: str, b: str) -> bool:
        """True if the merges keep ``a`` and ``b`` apart; remembered for the pair.

        Undoes the merges of the two, latest first, and looks for an earlier merge across.
        """
        rank, left, right, limit = self.rank, self.left, self.right, NEVER
        one, two = a, b
        while True:
            if rank.get(one + two, NEVER) < limit:
                answer = False
                break
            first, second = rank.get(one, -1), rank.get(two, -1)
            if first > second:
                limit, one = first, right[one]
            elif second >= 0:
                limit, two = second + 1, left[two]
            else:
                answer = True
                break
        if len(self.pairs) >= KEPT_WORDS:
            self.pairs.clear()
        self.pairs[a, b] = answer
        return answer

    def _tokens(self, part: str) -> list[str]:
        """Tokens of text that holds no run of spaces."""
        last: list[str] = [""] * (len(part) + 1)
        known, compatible = self.pairs.get, self.compatible
        for end, token in self.automaton.iter(part):
            end += 1
            if last[end]:
                continue
            before = end - len(token)
            if before:
                pair = last[before] or part[before - 1], token  # characters outside all tokens stand alone
                fits = known(pair)
                if not (compatible(*pair) if fits is None else fits):
                    continue
            last[end] = token
        found, end = [], len(part)
        while end:
            token = last[end] or part[end - 1]
            found.append(token)
            end -= len(token)
        return found[::-1]

    def _id_list(self, token: str) -> list[int]:
        if (known := self.ids.get(token)) is not None:
            return [known]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in token.encode()]

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        if (known := self.parts.get(part)) is None:
            if len(self.parts) >= KEPT_WORDS:
                self.parts.clear()
            known = self.parts[part] = self.packed([i for t in self._tokens(part) for i in self._id_list(t)])
        return known

    def _word(self, word: str) -> bytes:
        """Ids of a space and the characters up to the next one, cut where no token holds both neighbours."""
        text, joined = SPACE + word, self.joined
        if word.isalpha():
            return self.packed([i for t in self._tokens(text) for i in self._id_list(t)])
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined), len(text)]
        return b"".join(self._part(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))

    @functools.lru_cache(maxsize=4096)  # noqa: B019 - a worker has one model
    def spaces(self, count: int) -> bytes:
        """Ids of a run of spaces: equal ranks, so the leftmost pair joins first."""
        size, after = [1] * count, list(range(1, count + 1))
        before = list(range(-1, count - 1))
        ready = [i for i in range(count - 1) if 2 in self.blank]
        heapq.heapify(ready)
        while ready:
            i = heapq.heappop(ready)
            j = after[i] if size[i] else count
            if not size[i] or j >= count or size[i] + size[j] not in self.blank:
                continue
            size[i], size[j], after[i] = size[i] + size[j], 0, after[j]
            if after[j] < count:
                before[after[j]] = i
                heapq.heappush(ready, i)
            if before[i] >= 0:
                heapq.heappush(ready, before[i])
        return self.packed([self.ids[SPACE * n] for n in size if n])

    def word(self, word: str) -> bytes:
        if (known := self.words.get(word)) is None:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            known = self.words[word] = self._word(word)
        return known

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, begin and end ids included."""
        out = [self.packed([self.begin])]
        if text:
            words, known, missing = text.replace(SPACE, " ").split(" "), self.words, self.word
            alone = self.packed(self._id_list(SPACE))
            run = 0  # spaces before the word at hand, its own not counted
            for w in words[:-1] if words[-1] == "" else words:
                if w == "":
                    run += 1
                    continue
                ids = known.get(w) or missing(w)
                if run:  # the word's own space belongs to the run unless it joined the word
                    own = ids[:4] == alone
                    out.append(self.spaces(run + own))
                    ids, run = ids[4:] if own else ids, 0
                out.append(ids)
            if run or words[-1] == "":
                out.append(self.spaces(run + (words[-1] == "")))
        out.append(self.packed([self.end]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of this worker; tables of known words outlive a task."""
    return PieceModel(path)


def _mapped(df: DataFrame, source: str, target: str, kind, convert) -> DataFrame:
    """``df`` with ``target`` computed batch by batch; other columns pass through untouched."""
    schema = df.withColumn(target, F.lit(None).cast(kind)).schema
    at, place = df.columns.index(source), schema.names.index(target)
    arrow = pa.binary() if isinstance(kind, BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(convert(batch.column(at).to_pylist()), arrow)
            columns = [*batch.columns]
            columns[place : place + 1] = [made]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds (or replaces) ``ids``: the encoding of ``text`` as binary, four bytes an id, begin and end ids included.

    ``path`` is the model file, at the same place on every executor. A row is encoded where it is read:
    nothing is shuffled and a lost task is simply run again.
    """
    return _mapped(df, text, ids, BinaryType(), lambda texts: [model(path).encode(t or "") for t in texts])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds (or replaces) ``text``: the decoded ids; null ids decode to the empty text."""
    return _mapped(df, ids, text, StringType(), lambda all_ids: [model(path).decode(i or b"") for i in all_ids])
