"""Splitting texts into pre-tokens with numpy, and a cache of what is known about each distinct pre-token."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import repeat

import numpy as np

from brindle.llm.common import cached

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_CLASS: list[np.ndarray] = []
cached("vocab", _CLASS.clear)


def _class(cp: int) -> int:
    c = chr(cp)
    kind = unicodedata.category(c)[0]
    if kind == "L":
        return LETTER
    if kind == "N":
        return NUMBER
    return SPACE if cp in (0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) or 9 <= cp <= 13 or cp == 32 or 0x2000 <= cp <= 0x200A else OTHER


def classes(points: np.ndarray) -> np.ndarray:
    """Letter, number, white space or other, of each code point; a table that grows as blocks are met."""
    if not _CLASS:
        _CLASS.append(np.full(0x110000, 255, np.uint8))
    table = _CLASS[0]
    out = table[points]
    if (out == 255).any():
        for block in np.unique(points[out == 255] >> 8):
            table[block << 8 : (block + 1) << 8] = [_class(c) for c in range(block << 8, (block + 1) << 8)]
        out = table[points]
    return out


_TAILS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_level_starts(points: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the byte-level pattern start, in texts laid end to end.

    The pattern: contractions 's 't 're 've 'm 'll 'd, then an optional space with a run of letters, of numbers
    or of others, then white space up to the last one before ink.  ``limits`` are the texts' bounds.
    """
    n = len(points)
    kind = classes(points)
    edge = np.zeros(n + 1, bool)
    edge[limits] = True
    start = np.empty(n, bool)
    start[:1] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= edge[:n]
    white = kind == SPACE
    # White space right before ink is its own token, unless it is a plain space, which joins the ink.
    before_ink = np.zeros(n, bool)
    before_ink[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
    start |= before_ink
    joins = np.flatnonzero(before_ink & (points == 32)) + 1
    start[joins] = False
    for at in np.flatnonzero((points == 39) & start):
        stop = int(limits[np.searchsorted(limits, at, side="right")])
        tail = "".join(map(chr, points[at + 1 : min(at + 3, stop)]))
        size = next((len(t) for t in _TAILS if tail.startswith(t)), 0)
        if size:
            start[at + 1] = False
            if size == 2:
                start[at + 2] = False
            if at + 1 + size < stop and not (white[at + 1 + size]):
                start[at + 1 + size] = True
    return np.flatnonzero(start)


class Known:
    """Pre-tokens, byte for byte, with a ragged row of values each.  It is emptied beyond ``limit`` entries or
    ``size_limit`` bytes of pre-tokens."""

    def __init__(self, limit: int = 500_000, size_limit: int = 64 << 20):
        self.limit, self.size_limit = limit, size_limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.bytes = 0
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def rows(self, words: list[bytes], fill: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Row numbers of distinct ``words``; ``fill`` gives sizes and values of those that are not known."""
        if len(self.index) + len(words) > self.limit or self.bytes > self.size_limit:
            self.clear()
        found = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            sizes, values = fill(new)
            starts = len(self.pool) + np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            found[missing] = np.arange(len(self.at), len(self.at) + len(new))
            self.index.update(zip(new, found[missing].tolist(), strict=True))
            self.bytes += sum(map(len, new))
            self.pool = np.concatenate((self.pool, values.astype(np.uint32)))
            self.at = np.concatenate((self.at, starts))
            self.size = np.concatenate((self.size, sizes))
        return found


def ragged(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rows pool[at : at + size], one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(at - (ends - size), size)
    return pool[index]
