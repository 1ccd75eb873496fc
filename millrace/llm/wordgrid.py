"""Vectorised tokenisation of text batches: every word of a batch as a 64-bit hash with its place.

A batch of texts becomes one array of code points. Words are maximal runs of letters, marks and digits; an ideograph,
kana or hangul code point is a word of its own. Hashes are polynomial over code points modulo 2**64, taken from one
cumulative sum, so no Python loop runs over words.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SEP, WORD, DIGIT, WIDE = 0, 1, 2, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point of the basic plane; higher planes are looked up as they come."""
    table = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if 0x3040 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7AF or 0xF900 <= c <= 0xFAFF:
            table[c] = WIDE
        elif kind == "Nd":
            table[c] = DIGIT
        elif kind[0] in "LMN":
            table[c] = WORD
    return table


def classes(points: np.ndarray) -> np.ndarray:
    table = _classes()
    out = table[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        kind = unicodedata.category(chr(int(c)))
        out[points == c] = WIDE if 0x20000 <= c <= 0x3FFFF else DIGIT if kind == "Nd" else WORD if kind[0] in "LMN" else SEP
    return out


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Grid:
    """The words of a batch. `doc` numbers texts from 0; `start` and `end` are places in the joined code points."""

    points: np.ndarray
    begins: np.ndarray  # where each text starts in points, and at the last place where all end
    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    wide: np.ndarray
    first: np.ndarray  # index of each text's first word, and at the last place the number of words

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def join_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one line feed, and where each begins."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return points, np.concatenate(([0], np.cumsum(lengths)))


def grid(texts: list[str], lower: bool = True, digits: str = "keep") -> Grid:
    """Words of all texts. digits: 'keep' hashes them as they are, 'mask' gives every number the same hash."""
    texts = [t or "" for t in texts]
    if lower:
        folded = [t.lower() for t in texts]
        texts = [f if len(f) == len(t) else t for f, t in zip(folded, texts)]  # places stay those of the given text
    points, begins = join_points(texts)
    if not len(texts):
        none = np.zeros(0, np.int64)
        return Grid(points, np.zeros(1, np.int64), none, none.astype(np.uint64), none, none, none.astype(bool), np.zeros(1, np.int64))
    kind = classes(points)
    inside = kind != SEP
    prev_inside = np.concatenate(([False], inside[:-1]))
    wide = kind == WIDE
    prev_wide = np.concatenate(([False], wide[:-1]))
    starts = inside & (~prev_inside | wide | prev_wide)
    after = np.concatenate((starts[1:], [True])) | ~np.concatenate((inside[1:], [False]))
    ends = inside & after
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    values = points.astype(np.uint64) + np.uint64(1)
    if digits == "mask":
        values = np.where(kind == DIGIT, np.uint64(7), values)
    up, down = powers(len(points) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1])))
        h = mix((total[e] - total[s]) * down[s] + np.uint64(0x51))
    if digits == "mask":
        all_digits = np.concatenate(([0], np.cumsum(kind == DIGIT)))
        h = np.where(all_digits[e] - all_digits[s] == e - s, np.uint64(1), h)
    doc = np.searchsorted(begins, s, "right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return Grid(points, begins, doc, h, s, e, wide[s], first)


def shingles(g: Grid, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words that lies within one text, and the index of its first word."""
    n = len(g.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(g.doc[:n] == g.doc[k - 1 :])
    return runs(g, at, k), at


def runs(g: Grid, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the run of k words that starts at each of the places."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = h * _BASE + g.hash[at + j]
    return mix(h)


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a run of k words that starts at one of the places."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + k, n), -1)
    return np.cumsum(change[:-1]) > 0


def per_doc(g: Grid, values: np.ndarray) -> np.ndarray:
    """Sum of a value per word over each text."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[g.first[1:]] - total[g.first[:-1]]
