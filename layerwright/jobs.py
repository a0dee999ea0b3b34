from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from typing import TypeVar

T = TypeVar("T")
AT_ONCE = 4


def side_by_side(work: Callable[[str], T], names: Iterable[str]) -> dict[str, T]:
    """Start the Spark jobs of independent tables together, so that a small table's job does not
    wait for a large one's last task."""
    names = list(names)
    contexts = [copy_context() for _ in names]  # a thread sees the caller's staging folder
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(names, pool.map(lambda c, n: c.run(work, n), contexts, names)))
