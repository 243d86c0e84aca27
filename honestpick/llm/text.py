"""Words and shared frame helpers of the text operators.

A word is a maximal run of bytes other than space and \\x09-\\x0D; that is what bytes.split()
without an argument cuts, in C.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it holds `room` words."""

    def __init__(self, room: int = 400_000):
        super().__init__()
        self.room = room

    def __missing__(self, word):
        if len(self) >= self.room:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers (wraps on purpose)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(c: Column | str) -> Column:
    """A-Z only; lower() would also change other letters and even lengths."""
    return F.translate(c, _UPPER, _LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_pieces(column, rows: int = 2_000):
    """An Arrow text column as lists of Python strings, a few rows at a time."""
    for i in range(0, len(column), rows):
        yield i, column.slice(i, rows).to_pylist()


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base), dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class Hashed:
    """Hashes of all stretches of one sequence of symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.concatenate([np.zeros(1, np.uint64),
                                    np.cumsum(symbols * powers(_BASE, n), dtype=np.uint64)])
        self.back = powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start]
                   + (end - start).astype(np.uint64))


def lots(texts: list[str], chars: int = 2_500_000):
    """Index ranges of about so many characters."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
