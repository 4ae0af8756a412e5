"""DartMinHash: signatures of weighted sets.

Picture each element as a strip of the plane, as wide as its weight, running along
the axis of ranks. Hashing scatters darts over the strip, one per unit of area on
average, and gives each dart a coordinate of the signature. Where a dart lies
depends on the element alone, so sets that share a region share its darts. Each
coordinate keeps the earliest dart that fell to it. Two sets agree in a coordinate
with the probability of their weighted Jaccard similarity.

Only ranks below a bound are looked at. The bound is set so that the whole set gets
a few darts per coordinate however many elements it has: a large set takes few darts
from each element, most elements give none. A set that leaves a coordinate empty
is thrown again with twice the bound.
"""

import numpy as np

from harbor.llm.words import mix

SLACK = 3.0  # of the sets, about exp(-SLACK) are thrown again
ELEMENTS_AT_ONCE = 40_000
DARTS_AT_ONCE = 40_000
ALL = (1 << 64) - 1


def _uniform(values: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((values >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(doc, element, weight, bound, size, ranks, darts):
    """Throw the darts of ranks up to ``bound`` (per document) and keep the earliest of each coordinate."""
    for unit in range(int(np.ceil(weight.max(initial=0)))):
        wide = weight > unit
        d, w, top = doc[wide], weight[wide] - unit, bound[doc[wide]]
        full = bool((w >= 1).all())  # no dart can miss the strip
        seed = mix(element[wide] + np.uint64((unit + 1) * 0xA0761D6478BD642F & ALL))
        rank, thrown = np.zeros(len(d)), 0
        while len(d):
            count = max(1, DARTS_AT_ONCE // len(d))  # darts of each strip in this round
            steps = np.array([(thrown + n) * 0xE7037ED1A0B428DB & ALL for n in range(1, count + 1)], np.uint64)
            dart = mix(seed[:, None] + steps[None, :])
            gaps = -np.log(_uniform(dart))  # between darts along a strip of width one
            gaps[:, 0] += rank
            when = np.cumsum(gaps, axis=1, out=gaps)
            strip, step = np.nonzero(when <= top[:, None])
            at, early, which = d[strip], when[strip, step], dart[strip, step]
            of = mix(which ^ np.uint64(0x8EBC6AF09C88C6E3))
            if not full:
                hit = np.flatnonzero(_uniform(of) < w[strip])
                at, early, which, of = at[hit], early[hit], which[hit], mix(of[hit])
            place = at * size + (of % np.uint64(size)).astype(np.int64)
            np.minimum.at(ranks, place, early)
            first = np.flatnonzero(ranks[place] == early)
            darts[place[first]] = which[first]
            more = np.flatnonzero(when[:, -1] <= top)
            d, w, top, seed, rank = d[more], w[more], top[more], seed[more], when[more, -1]
            thrown += count


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """``docs`` rows of ``size`` darts from elements sorted by document; all zero for a set without weight."""
    ranks, darts = np.full(docs * size, np.inf), np.zeros(docs * size, np.uint64)
    total = np.bincount(doc, weight, docs)
    bound = size * (np.log(size) + SLACK) / np.maximum(total, 1e-300)
    waiting = total > 0
    while waiting.any():
        use = waiting[doc]
        _throw(doc[use], element[use], weight[use], bound, size, ranks, darts)
        waiting &= np.isinf(ranks.reshape(docs, size)).any(axis=1)
        bound = bound * 2
    return darts.reshape(docs, size)


def in_parts(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """``signatures`` for some documents at a time, to bound memory."""
    out = np.zeros((docs, size), np.uint64)
    limits = np.searchsorted(doc, np.arange(docs + 1))
    begin = 0
    while begin < docs:
        room = max(1, ELEMENTS_AT_ONCE // size)
        end = int(np.searchsorted(limits, limits[begin] + ELEMENTS_AT_ONCE, "right")) - 1
        end = min(docs, max(begin + 1, min(end, begin + room)))
        a, b = limits[begin], limits[end]
        out[begin:end] = signatures(doc[a:b] - begin, element[a:b], weight[a:b], end - begin, size)
        begin = end
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Band keys: a hash of ``rows`` neighbouring darts and their place; the last columns short of a band are left out."""
    docs, size = signature.shape
    count = size // rows
    keys = np.zeros((docs, count), np.uint64)
    weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    for row in range(rows):
        keys += signature[:, row : count * rows : rows] * weights[row]
    return mix(keys + mix(np.arange(1, count + 1, dtype=np.uint64))[None, :])
