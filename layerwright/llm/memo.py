"""Numbers computed for words, kept while a task meets the same words again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words that a task keeps beside those it was given, and letters they have together; when there are more, it starts anew.
KEPT, LETTERS = 100_000, 4 << 20


class Memo:
    """Rows of numbers by word: those of ``words`` are given, ``compute`` gives the rows of words not met yet."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], words: list[str], rows: np.ndarray):
        self.compute, self.given = compute, dict(zip(words, range(len(words)), strict=True))
        self.rows = np.concatenate([rows, np.zeros((4096, rows.shape[1]))])
        self._forget()

    def _forget(self) -> None:
        self.known, self.letters, self.end = {}, 0, len(self.given)

    def __call__(self, words: list[str]) -> np.ndarray:
        """The rows of distinct words."""
        if len(self.known) > KEPT or self.letters > LETTERS:
            self._forget()
        known, given = self.known, self.given
        new = [w for w in words if w not in given and w not in known]
        end = self.end + len(new)
        if end > len(self.rows):
            more = np.zeros((max(end - len(self.rows), len(self.rows) // 2), self.rows.shape[1]))
            self.rows = np.concatenate([self.rows, more])
        if new:
            self.rows[self.end : end] = self.compute(new)
            known.update(zip(new, range(self.end, end), strict=True))
            self.letters += sum(map(len, new))
            self.end = end
        at = [given[w] if w in given else known[w] for w in words]
        return self.rows[at] if words else self.rows[:0]
