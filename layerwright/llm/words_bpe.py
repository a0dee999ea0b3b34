"""Token ids of the word-end BPE vocabulary, for the words of some megabytes of text together.

The vocabulary's own pipeline (composition, lower case, splitting) never looks across white space, so a text's
ids are the ids of the parts between spaces and U+0009 to U+000D. Parts of plain letters, digits and signs are cut into the vocabulary's words by the
kinds of neighbouring bytes, in all texts at once, and each distinct word is merged once: words of as many tokens stand in an array, a row each, every
row joins its pair of lowest rank, and so all rows have a token less and meet the words that had so many to begin with.
Any other part and words of more than ``LONGEST`` bytes go through the ``tokenizers`` library as they are, unless a worker met them lately.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view

from .hashing import grouped, hashes_of, joined, lowered

#: Bytes of parts whose ids from the library a worker has at hand: those met last that take so many, and as many before; bytes that an entry takes beside its own.
KEPT, ENTRY = 24 << 20, 160
#: Parts in one call of the library; bytes of text whose words are merged together; bytes of the longest word that is.
AT_ONCE, TEXT_AT_ONCE, LONGEST = 4096, 4 << 20, 32
END = "</w>"
#: The vocabulary's letters for bytes: printable ones stand for themselves, the others follow from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTED]
LETTERS = [chr(b if b in _PRINTED else 256 + _OTHERS.index(b)) for b in range(256)]
#: Kinds of bytes. A letter of À to ÿ is C3 and a byte of ``_ACCENTED``; no other byte beyond ASCII is plain.
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
_KIND = np.full(256, OTHER, "uint8")
_KIND[33:127] = SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = BLANK
_ACCENTED = np.zeros(256, bool)
_ACCENTED[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
_ACCENTED_LOWER = np.arange(256, dtype="uint8")
_ACCENTED_LOWER[0x80:0x9F] += 32
#: The words of an apostrophe and letters, by the bytes behind the apostrophe.
_SHORT, _LONG = np.zeros(256, bool), np.zeros((256, 256), bool)
_SHORT[list(b"stmd")] = True
for _a, _b in (b"re", b"ve", b"ll"):
    _LONG[_a, _b] = True


class Recent:
    """Values of keys met lately: when the new ones are full, they become the old ones, whose values come back if met again."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}
        self.size = 0

    def add(self, key, value: bytes) -> None:
        self.new[key] = value
        self.size += len(key) + len(value) + ENTRY

    def missing(self, keys: Iterable) -> list:
        """Keys without a value; the values of all others are in ``new`` afterwards."""
        if self.size > KEPT:
            self.old, self.new, self.size = self.new, {}, 0
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                if k in old:
                    self.add(k, old[k])
                else:
                    out.append(k)
        return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Merges:
    """The vocabulary's merges, for many words at once."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        left, right = (np.array([vocabulary[pair[i]] for pair in merges], "int64") for i in (0, 1))
        self.pairs = pd.Index(left << 32 | right)  # the place of a pair is its rank
        self.kind = np.min_scalar_type(max(len(merges), *vocabulary.values()))  # narrow numbers: arrays of them are moved at every merge
        self.made = np.array([vocabulary[a + b] for a, b in merges], self.kind)
        self.inner = np.array([vocabulary[c] for c in LETTERS], self.kind)
        self.last = np.array([vocabulary[c + END] for c in LETTERS], self.kind)
        every = np.repeat(self.inner, 256)
        self.first_ranks, self.last_ranks = (self.ranks(every, np.tile(x, 256)).reshape(256, 256) for x in (self.inner, self.last))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; of those that do not merge, the highest number."""
        return self.pairs.get_indexer(left.astype("int64") << 32 | right).astype(self.kind)

    def ids(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words at these places of ``raw`` in some order, and where each word's begin and how many they are."""
        n = ends - starts
        begin, size, flat, total = np.zeros(len(n), "int64"), np.zeros(len(n), "int64"), [], 0
        by_length = np.argsort(n.astype("uint8"), kind="stable")
        bounds = np.searchsorted(n[by_length], np.arange(LONGEST + 2))
        which = np.zeros(0, "int64")
        for k in range(int(n.max(initial=0)), 0, -1):
            more = by_length[bounds[k] : bounds[k + 1]]
            letters = sliding_window_view(raw, k)[starts[more]]
            new, new_ranks = self.inner[letters], self.first_ranks[letters[:, :-1], letters[:, 1:]]
            new[:, -1] = self.last[letters[:, -1]]
            if k > 1:
                new_ranks[:, -1] = self.last_ranks[letters[:, -2], letters[:, -1]]
            if len(which):
                which, tokens, ranks = np.concatenate([which, more]), np.concatenate([tokens, new]), np.concatenate([ranks, new_ranks])
            else:
                which, tokens, ranks = more, new, new_ranks
            if k > 1:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(at)), at]
                merge = best < len(self.made)
            else:
                merge = np.zeros(len(which), bool)
            done = which[~merge]
            flat.append(tokens[~merge].ravel())
            begin[done], size[done] = total + k * np.arange(len(done)), k
            total += k * len(done)
            if merge.any():
                which, tokens, ranks, at, best = which[merge], tokens[merge], ranks[merge], at[merge], best[merge]
                row = np.arange(len(which))
                tokens[row, at] = self.made[best]
                stays = np.arange(k) != at[:, None] + 1
                tokens = tokens[stays].reshape(len(row), k - 1)
                ranks = ranks[stays[:, 1:]].reshape(len(row), k - 2)
                for some, pair in ((at > 0, at - 1), (at < k - 2, at)):
                    rows, pair = row[some], pair[some]
                    ranks[rows, pair] = self.ranks(tokens[rows, pair], tokens[rows, pair + 1])
            else:
                which = which[:0]
        return np.concatenate([np.zeros(0, self.kind), *flat]).astype("<u4"), begin, size


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        self.parts = Recent()

    def _library(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts."""
        new = self.parts.missing(parts)
        for a in range(0, len(new), AT_ONCE):
            some = new[a : a + AT_ONCE]
            for part, found in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False), strict=True):
                self.parts.add(part, np.asarray(found.ids, "<u4").tobytes())
        known = self.parts.new
        return [known[p] for p in parts]

    def _words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The text in lower case; where words and parts that are not plain (which stay as they are) begin and end in it, and which are such parts."""
        low, kind = lowered(raw), _KIND[raw]
        first = np.flatnonzero(raw == 0xC3)
        first = first[_ACCENTED[raw[first + 1]]]
        low[first + 1] = _ACCENTED_LOWER[raw[first + 1]]
        kind[first] = kind[first + 1] = LETTER
        blank = kind == BLANK
        cut = np.diff(kind, prepend=kind[0] + 1).astype(bool) | (kind == DIGIT)
        quote = np.flatnonzero(raw == ord("'"))
        quote = quote[cut[quote] & (kind[quote + 1] == LETTER)]
        short, long = quote[_SHORT[low[quote + 1]]], quote[_LONG[low[quote + 1], low[quote + 2]]]
        cut[short + 1] = cut[long + 1] = False
        cut[short + 2] = cut[long + 3] = True
        kind[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = OTHER
        other, whole = np.flatnonzero(kind == OTHER), np.zeros(len(raw), bool)
        if len(other):
            edge = np.flatnonzero(np.diff(blank.astype("int8"), prepend=1))
            of = np.unique(np.searchsorted(edge[0::2], other, "right") - 1)
            start, n = edge[0::2][of], edge[1::2][of] - edge[0::2][of]
            inside = ranges(start, n)
            low[inside], cut[inside], cut[start], whole[start] = raw[inside], False, True, True
        cuts = np.flatnonzero(cut)
        some = np.flatnonzero(~blank[cuts])
        starts = cuts[some]
        return low, starts, cuts[some + 1], whole[starts]

    def _group(self, texts: list[bytes | None]) -> list[bytes]:
        raw, begin = joined(texts)
        low, starts, ends, whole = self._words(raw)
        back, _ = pd.factorize(hashes_of(low, starts, ends))
        first = np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=-1))
        a, b = starts[first], ends[first]
        apart = whole[first] | (b - a > LONGEST)
        at, n = np.empty(len(first), "int64"), np.empty(len(first), "int64")
        flat, at[~apart], n[~apart] = self.merges.ids(low, a[~apart], b[~apart])
        if apart.any():
            found = self._library([low[i:j].tobytes() for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True)])
            size = np.fromiter(map(len, found), "int64", len(found)) // 4
            at[apart], n[apart] = len(flat) + np.cumsum(size) - size, size
            flat = np.concatenate([flat, np.frombuffer(b"".join(found), "<u4")])
        sizes = n[back]
        laid = flat[ranges(at[back], sizes)].tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, begin)]).tolist()
        return [laid[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[bytes | None], at_once: int = TEXT_AT_ONCE) -> list[bytes]:
        """Ids of each text (UTF-8) as little-endian unsigned 32-bit integers, no ids added; null as empty."""
        return [ids for some in grouped(texts, at_once) for ids in self._group(texts[some])]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker; what it met outlives a task."""
    return WordTokenizer(path)
