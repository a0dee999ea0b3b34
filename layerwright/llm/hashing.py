"""Words and word windows of many texts at once, as arrays of 64-bit hashes.

A word is a run of bytes other than space and U+0009 to U+000D. Hashes are polynomials over 2**64 with random
coefficients for the bytes, taken from running sums, so a batch needs no loop over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text handled at once; a longer text is handled alone.
AT_ONCE = 1 << 20
_random = np.random.default_rng(20260101)
_BYTE = _random.integers(1, 1 << 63, 256, dtype="uint64")
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_WORD_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below ``n``, modulo 2**64; kept by the worker."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, "uint64")
        known[0] = 1
        known = _powers[base] = np.cumprod(known, dtype="uint64")
    return known[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def running(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums that ``between`` turns into hashes of ranges."""
    sums = np.zeros(len(values) + 1, "uint64")
    np.cumsum(values * powers(base, len(values)), dtype="uint64", out=sums[1:])
    return sums


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * powers(inverse(base), len(sums))[starts] + (ends - starts).astype("uint64"))


@dataclass(frozen=True)
class Words:
    """Words of some texts: ``first[i]`` to ``first[i + 1]`` are those of text i; byte ranges are in ``raw``."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``n`` words inside one text, and the windows' hashes."""
        at = np.arange(max(0, len(self.hashes) - n + 1))
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = at[at + n <= last[: len(at)]]
        return at, between(running(self.hashes, _WINDOW_BASE), at, at + n, _WINDOW_BASE)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of word ranges."""
        return between(running(self.hashes, _WINDOW_BASE), starts, ends, _WINDOW_BASE)


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z folded."""
    return _LOWER[raw]


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with a line feed behind each, and where each text begins, and the end."""
    raw = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", "uint8")
    begin = np.zeros(len(texts) + 1, "int64")
    np.cumsum([len(t or b"") + 1 for t in texts], out=begin[1:])
    return raw, begin


def hashes_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges."""
    return between(running(_BYTE[raw], _WORD_BASE), starts, ends, _WORD_BASE)


def words_of(texts: list[bytes | None], lower: bool = False) -> Words:
    """``lower`` folds A-Z."""
    raw, begin = joined(texts)
    if lower:
        raw = lowered(raw)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(blank.astype("int8"), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    return Words(raw, starts, ends, np.searchsorted(starts, begin), hashes_of(raw, starts, ends))


def grouped(texts: list[bytes | None], at_once: int = AT_ONCE) -> Iterator[slice]:
    """Slices of ``texts`` of about ``at_once`` bytes."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t or b"") > at_once:
            yield slice(start, i)
            start, total = i, 0
        total += len(t or b"") + 1
    if start < len(texts):
        yield slice(start, len(texts))
