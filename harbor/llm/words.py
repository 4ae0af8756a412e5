"""Words of many texts at once, as arrays.

Texts are held as one array of code points. Words are what white space separates;
each gets a 64-bit hash of its lower-case code points, from differences of one
running sum, so that no step works word by word.
"""

from dataclasses import dataclass
from functools import cache

import numpy as np

from harbor.llm.common import keeps

SPACE, DIGIT, LETTER, UPPER = 1, 2, 4, 8
FACTOR = 0x9E3779B97F4A7C15 | 1  # any odd number has an inverse modulo 2 ** 64
INVERSE = pow(FACTOR, -1, 1 << 64)


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower case of the code points up to 65535; those above count as letters."""
    kinds, lower = np.zeros(65536, np.uint8), np.arange(65536, dtype=np.uint32)
    for code in range(65536):
        char = chr(code)
        kinds[code] = SPACE * char.isspace() | DIGIT * char.isdecimal() | LETTER * char.isalpha() | UPPER * char.isupper()
        small = char.lower()
        if len(small) == 1:
            lower[code] = ord(small)
    return kinds, lower


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


KEPT_POWERS = 1 << 19


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, of at least ``size`` places; kept up to a usual batch."""
    return _kept_powers() if size <= KEPT_POWERS else _new_powers(size)


@cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(KEPT_POWERS)


keeps("words", _kept_powers.cache_clear)


def _new_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (FACTOR, INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


@dataclass
class Words:
    """Words in order. ``doc`` is the index of the text, ``begin`` and ``end`` are places in ``points``."""

    points: np.ndarray  # lower-case code points of all texts, a blank after each
    kinds: np.ndarray  # class bits of the same places, of the texts as written
    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def hashes(self, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word, or of the given spans."""
        begin, end = (self.begin, self.end) if begin is None else (begin, end)
        steps, inverses = powers(len(self.points) + 1)
        sums = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * steps[: len(self.points)], out=sums[1:])
        spans = (sums[end] - sums[begin]) * inverses[begin]
        return mix(spans + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(texts: list[str]) -> Words:
    """All words of ``texts``; a text without any has none."""
    kind_of, lower_of = _classes()
    points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    low = np.minimum(points, 65535)
    kinds = np.where(points < 65536, kind_of[low], LETTER).astype(np.uint8)
    points = np.where(points < 65536, lower_of[low], points).astype(np.uint32)
    inside = np.concatenate([[False], (kinds & SPACE) == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    ends = np.cumsum(np.array([len(text) + 1 for text in texts], np.int64))
    return Words(points, kinds, np.searchsorted(ends, begin, "right"), begin, end)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``size`` words: text index and hash, sorted by both.

    A text of fewer words, but of one at least, has one shingle of all its words.
    """
    values, doc = words.hashes(), words.doc
    total = len(values)
    counts = np.bincount(doc) if total else np.zeros(0, np.int64)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(max(0, total - size + 1), np.uint64)
    for place in range(size):
        out += values[place : place + len(out)] * weights[place]
    whole = doc[: len(out)] == doc[size - 1 :] if len(out) else np.zeros(0, bool)
    docs, found = doc[: len(out)][whole], mix(out[whole])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        places = np.concatenate([[0], np.cumsum(counts)])[short]
        joined = [
            mix(np.array([sum(int(v) * int(w) for v, w in zip(values[p : p + counts[d]], weights, strict=False)) + int(counts[d]) & (1 << 64) - 1], np.uint64))[0]
            for d, p in zip(short, places, strict=True)
        ]
        docs, found = np.concatenate([docs, short]), np.concatenate([found, np.array(joined, np.uint64)])
    order = np.lexsort((found, docs))
    docs, found = docs[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])
    return docs[new], found[new]
