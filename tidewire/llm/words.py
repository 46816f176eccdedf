"""Words, hashes and chunks that the text operators of this package share. Plain numpy; no Spark."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Words whose numbers a worker keeps at once.
KEPT_WORDS = 400_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str | None) -> list[str]:
    """Words of a text after lower-casing; null has none."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of words, the same in every process. Keeps those it has seen, up to a bound."""

    def __init__(self, most: int = KEPT_WORDS) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """Hashes of all words of all lists, one after the other."""
        flat = list(chain.from_iterable(texts))
        if len(self.known) > self.most:
            self.known.clear()
        for w in set(flat) - self.known.keys():
            self.known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.fromiter(map(self.known.__getitem__, flat), np.uint64, len(flat))


def runs_of_words(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one document, and the place of each run's first word. doc: number of each word's document, ascending."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[at + i])
    return h, at


def chunks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive rows of about ``most`` units in all; a larger row is a slice of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at starts and have these lengths, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)
