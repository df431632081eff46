"""What a Python worker keeps from one task to the next: the memory of one operator, the newest."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa

#: Words longer than this are computed each time and not remembered, so that a memory is bounded in bytes.
LONGEST_KEY = 64

_HELD: dict[Hashable, object] = {}


def held(mark: Hashable, build: Callable[[], object]) -> object:
    """This worker's object of that mark, made once.

    Workers outlive stages, so an object of another mark goes first: a worker
    that has served five operators holds no more than one that served the last.
    """
    if mark not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[mark] = build()
    return _HELD[mark]


def _make_room(mark: Hashable) -> None:
    for other in [m for m in _HELD if m != mark and not (isinstance(m, tuple) and m[0] == mark)]:
        del _HELD[other]


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidy(work: Callable[[Iterable], Iterator], mark: Hashable = None) -> Callable[[Iterable], Iterator]:
    """``work`` over a task's batches; what other operators left in the worker goes before, and freed memory goes back to the system after."""

    def run(batches: Iterable) -> Iterator:
        _make_room(mark)
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


class Remembered(dict):
    """What ``compute`` gives for a word; forgets all when ``most`` words are known."""

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= LONGEST_KEY:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value
