"""Periodic runs of words, found in a grammar of the texts.

A run is a stretch of words with smallest period q, at least max(6, 4 q) words long,
that cannot be extended either way keeping q.

1. Re-Pair: neighbouring word ids that occur together again become one symbol, the most
   frequent pairs first, round after round. What is left of a text is paired up as a
   balanced tree. Each symbol of two parts is a node with one boundary inside.
2. A run lies across the boundary of the least node that holds it. So for each node the
   runs across its boundary are computed, once for a symbol however often it occurs.
   One side holds two periods at least; a period is tried only if the two words at the
   boundary come back at that distance, and is then extended by comparing hashes.
3. What a symbol holds is translated to all places that derive from it.
4. Of the pieces of one period the maximal ones are the runs. Each is compared with
   the words themselves, so hashes that meet by chance cannot change a result.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbor.llm.common import text_slices, trimmed, whole_text
from harbor.llm.words import mix, powers

LEAST_LENGTH, LEAST_PERIODS = 6, 4
AT_ONCE = 1 << 20  # tried periods held at once
SHRINKS = 0.01  # a round of pairs that shortens the texts by less is the last

Places = Callable[[int, int], np.ndarray | None]
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


@dataclass
class Texts:
    """Word ids of several texts in a row; text n has the places ``limits[n]`` to ``limits[n + 1]``."""

    ids: np.ndarray
    limits: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.limits) - 1), np.diff(self.limits))


@dataclass
class Grammar:
    """Symbols made of pairs, numbered from ``base``, and what they leave of the texts."""

    base: int
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray  # a place in the texts that the symbol derives
    length: np.ndarray  # in words, of all symbols
    rounds: list[tuple[int, int]]  # symbols made in each round
    symbols: np.ndarray
    places: np.ndarray
    doc: np.ndarray


def _chosen(key: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose pair becomes a symbol, and the number of that pair.

    A pair gives way to one beside it that is more frequent. Of a stretch of one
    repeated word, whose pairs are all alike, every second place is taken.
    """
    found, number, counts = np.unique(key[valid], return_inverse=True, return_counts=True)
    weight = np.zeros(len(key) + 2, np.int64)  # a place before and one after all
    often = counts[number]
    weight[np.flatnonzero(valid) + 1] = np.where(often > 1, often * len(found) + number + 1, 0)
    before, here, after = weight[:-2], weight[1:-1], weight[2:]
    starts = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
    begin = np.repeat(starts, np.diff(np.append(starts, len(here))))
    offset = np.arange(len(here)) - begin - (here[begin] < before[begin])
    chosen = np.flatnonzero((here > 0) & (offset >= 0) & (offset % 2 == 0) & (here >= after))
    pair = (here[chosen] - 1) % len(found)
    again = np.bincount(pair, minlength=len(found))[pair] > 1
    return chosen[again], pair[again]


def re_pair(texts: Texts, vocabulary: int) -> Grammar:
    """A grammar whose pairs never reach over the end of a text. How far it goes does not change any run."""
    symbols, places, doc = texts.ids.astype(np.int64), np.arange(len(texts.ids)), texts.doc
    length, size = np.ones(vocabulary, np.int64), vocabulary
    left, right, first, rounds = [], [], [], []
    while len(symbols) > 1:
        key = symbols[:-1] * size + symbols[1:]
        valid = doc[:-1] == doc[1:]
        if not valid.any():
            break
        at, pair = _chosen(key, valid)
        if not len(at):
            break
        _, where, number = np.unique(pair, return_index=True, return_inverse=True)
        a, b = symbols[at[where]], symbols[at[where] + 1]
        left.append(a)
        right.append(b)
        first.append(places[at[where]])
        length = np.concatenate([length, length[a] + length[b]])
        symbols[at] = size + number
        rounds.append((size, size + len(where)))
        size += len(where)
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, places, doc = symbols[stay], places[stay], doc[stay]
        if len(at) < SHRINKS * len(stay):
            break
    none = [np.zeros(0, np.int64)]
    return Grammar(
        vocabulary, np.concatenate(none + left), np.concatenate(none + right), np.concatenate(none + first), length,
        rounds, symbols, places, doc,
    )


def _tree(grammar: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, boundary and end of the nodes of balanced trees over what is left of each text."""
    begin, end, doc = grammar.places, grammar.places + grammar.length[grammar.symbols], grammar.doc
    out = [np.zeros((3, 0), np.int64)]
    while len(doc):
        firsts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rank = np.arange(len(doc)) - np.repeat(firsts, np.diff(np.append(firsts, len(doc))))
        partner = np.zeros(len(doc), bool)
        partner[:-1] = (rank[:-1] % 2 == 0) & (doc[1:] == doc[:-1])
        at = np.flatnonzero(partner)
        if not len(at):
            break
        out.append(np.stack([begin[at], end[at], end[at + 1]]))
        end = end.copy()
        end[at] = end[at + 1]
        stay = rank % 2 == 0
        begin, end, doc = begin[stay], end[stay], doc[stay]
    joined = np.concatenate(out, axis=1)
    return joined[0], joined[1], joined[2]


class _Hashes:
    """Hashes of stretches of words, from differences of one running sum."""

    def __init__(self, ids: np.ndarray):
        self.powers, self.inverses = powers(len(ids) + 1)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * self.powers[: len(ids)], out=self.sums[1:])

    def of(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[begin + size] - self.sums[begin]) * self.inverses[begin]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on (or before them) are the same, ``most`` at most."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while True:
            going = np.flatnonzero(low < high)
            if not len(going):
                return low
            half = (low[going] + high[going] + 1) // 2
            shift = half if back else 0
            same = self.of(a[going] - shift, half) == self.of(b[going] - shift, half)
            low[going[same]] = half[same]
            high[going[~same]] = half[~same] - 1


def _blocks(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of entries whose counts add up to about AT_ONCE."""
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(counts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        yield begin, end
        begin = end


def crossing_runs(
    ids: np.ndarray, hashes: _Hashes, begin: np.ndarray, boundary: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs inside each node across its boundary: node, begin, end, smallest period."""
    out = [np.zeros((4, 0), np.int64)]
    for on_right in (True, False):
        side = end - boundary if on_right else boundary - begin
        tried = np.where(end - begin >= LEAST_LENGTH, side // 2, 0)
        for a, b in _blocks(tried):
            node = np.repeat(np.arange(a, b), tried[a:b])
            period = np.arange(len(node)) - np.repeat(np.cumsum(tried[a:b]) - tried[a:b], tried[a:b]) + 1
            anchor = boundary[node] - 1 - (0 if on_right else period)
            hit = np.flatnonzero(ids[anchor] == ids[anchor + period])
            hit = hit[ids[anchor[hit] + 1] == ids[anchor[hit] + 1 + period[hit]]]
            node, period, anchor = node[hit], period[hit], anchor[hit]
            ahead = hashes.common(anchor, anchor + period, end[node] - anchor - period)
            behind = hashes.common(anchor, anchor + period, anchor - begin[node], back=True)
            start, stop = anchor - behind, anchor + period + ahead
            long = np.flatnonzero(stop - start >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period))
            out.append(np.stack([node[long], start[long], stop[long], period[long]]))
    found = np.concatenate(out, axis=1)
    found = found[:, np.lexsort((found[3], found[2], found[1], found[0]))]
    least = np.ones(found.shape[1], bool)
    least[1:] = (found[:3, 1:] != found[:3, :-1]).any(axis=0)
    node, start, stop, period = found[:, least]
    return node, start, stop, period


def _derived(grammar: Grammar, carries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places that derive from the symbols that ``carries`` marks: symbol and place.

    Only symbols with a marked one below them are followed.
    """
    base, wanted = grammar.base, np.concatenate([np.zeros(grammar.base, bool), carries])
    for low, high in grammar.rounds:
        wanted[low:high] |= wanted[grammar.left[low - base : high - base]] | wanted[grammar.right[low - base : high - base]]
    waiting = wanted[grammar.symbols]
    symbol, place = grammar.symbols[waiting], grammar.places[waiting]
    out = [np.zeros((2, 0), np.int64)]
    for low, high in reversed(grammar.rounds):
        now = symbol >= low
        s, p = symbol[now], place[now]
        marked = carries[s - base]
        out.append(np.stack([s[marked] - base, p[marked]]))
        a, b = grammar.left[s - base], grammar.right[s - base]
        below = np.concatenate([a, b]), np.concatenate([p, p + grammar.length[a]])
        follow = wanted[below[0]]
        symbol = np.concatenate([symbol[~now], below[0][follow]])
        place = np.concatenate([place[~now], below[1][follow]])
    found = np.concatenate(out, axis=1)
    return found[0], found[1]


def _maximal(texts: Texts, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The pieces that lie in no other piece of the same text and period, as rows of doc, start, stop, period."""
    doc = np.searchsorted(texts.limits, start, "right") - 1
    order = np.lexsort((-stop, start, period, doc))
    rows = np.stack([doc, start, stop, period])[:, order]
    if not rows.shape[1]:
        return rows
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[3, 1:] != rows[3, :-1])
    lifted = rows[2] + np.cumsum(new) * (len(texts.ids) + 1)
    reached = np.maximum.accumulate(lifted)
    stays = new.copy()
    stays[1:] |= lifted[1:] > reached[:-1]
    return rows[:, stays]


def _untrue(texts: Texts, runs: np.ndarray) -> np.ndarray:
    """Texts with a run that the words themselves do not confirm."""
    ids, bad = texts.ids, np.zeros(runs.shape[1], bool)
    doc, start, stop, period = runs
    inner = np.flatnonzero(start > texts.limits[doc])
    bad[inner] = ids[start[inner] - 1] == ids[start[inner] - 1 + period[inner]]
    inner = np.flatnonzero(stop < texts.limits[doc + 1])
    bad[inner] |= ids[stop[inner]] == ids[stop[inner] - period[inner]]
    sizes = stop - start - period
    for a, b in _blocks(sizes):
        run = np.repeat(np.arange(a, b), sizes[a:b])
        place = np.arange(len(run)) - np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b]) + start[run]
        bad[run[ids[place] != ids[place + period[run]]]] = True
    return np.unique(doc[bad])


def plain_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, stop and period of the runs of one text, trying every period; quadratic."""
    found: dict[tuple[int, int], int] = {}
    for period in range(1, len(words) // LEAST_PERIODS + 1):
        same = np.concatenate([[False], words[:-period] == words[period:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, stop in zip(edges[::2].tolist(), (edges[1::2] + period).tolist(), strict=True):
            if stop - start >= max(LEAST_LENGTH, LEAST_PERIODS * period):
                found.setdefault((start, stop), period)
    return [(start, stop, period) for (start, stop), period in found.items()]


def runs_of(texts: Texts, vocabulary: int) -> np.ndarray:
    """All runs, as rows of doc, start, stop, period, by doc, start and period; places count over all texts."""
    grammar = re_pair(texts, vocabulary)
    hashes = _Hashes(texts.ids)
    middle = grammar.first + grammar.length[grammar.left]
    end = grammar.first + grammar.length[grammar.base :]
    symbol, start, stop, period = crossing_runs(texts.ids, hashes, grammar.first, middle, end)
    carries = np.zeros(len(grammar.left), bool)
    carries[symbol] = True
    derived, place = _derived(grammar, carries)
    # every run of a symbol at every place of it
    lows, highs = np.searchsorted(symbol, derived), np.searchsorted(symbol, derived, "right")
    of_place = np.repeat(np.arange(len(derived)), highs - lows)
    run = np.arange(len(of_place)) - np.repeat(np.cumsum(highs - lows) - (highs - lows), highs - lows) + lows[of_place]
    shift = place[of_place] - grammar.first[symbol[run]]
    _, top_start, top_stop, top_period = crossing_runs(texts.ids, hashes, *_tree(grammar))
    runs = _maximal(
        texts, np.concatenate([start[run] + shift, top_start]), np.concatenate([stop[run] + shift, top_stop]),
        np.concatenate([period[run], top_period]),
    )
    for doc in _untrue(texts, runs):
        low, high = texts.limits[doc], texts.limits[doc + 1]
        plain = [(doc, low + a, low + b, q) for a, b, q in plain_runs(texts.ids[low:high])]
        runs = np.concatenate([runs[:, runs[0] != doc], np.array(plain, np.int64).reshape(-1, 4).T], axis=1)
    return runs[:, np.lexsort((runs[3], runs[1], runs[0]))]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in a row, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    doc = np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths()))
    return words.filter(some), np.bincount(doc[np.asarray(some)], minlength=len(texts))


def collapsed_texts(texts: Texts, runs: np.ndarray, vocabulary: pa.Array) -> pa.Array:
    """The texts without what a run repeats: its words after the first period go."""
    change = np.zeros(len(texts.ids) + 1, np.int64)
    np.add.at(change, runs[1] + runs[3], 1)
    np.add.at(change, runs[2], -1)
    stay = np.cumsum(change[:-1]) == 0
    kept = np.bincount(texts.doc[stay], minlength=len(texts.limits) - 1)
    words = vocabulary.take(pa.array(texts.ids[stay]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)).astype(np.int32)), words), " ")


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", places: Places | None = None) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, its runs (by start, then period) and the collapsed text.

    Words are what blanks and the characters 9 to 13 separate, compared as they are.
    ``places`` may rearrange a text: given its id and its number of words it returns
    which word stands at each place, or nothing to leave the text as it is.
    A null text is empty and has no words; its collapsed text is empty. Rows repeat as
    they come, null ids stay null; no row moves; extra columns are left behind.
    """
    kinds = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches, "words"):
            ids = batch.column(0).to_pylist()
            for a, b in text_slices(batch.column(1)):
                words, counts = _words(batch.column(1).slice(a, b - a))
                coded = words.dictionary_encode()
                limits = np.append(0, np.cumsum(counts))
                numbers = np.asarray(coded.indices).astype(np.int64)
                for n, doc in enumerate(ids[a:b] if places else ()):
                    moved = places(doc, int(counts[n])) if doc is not None and counts[n] else None
                    if moved is not None:
                        numbers[limits[n] : limits[n + 1]] = numbers[limits[n] : limits[n + 1]][moved]
                texts = Texts(numbers, limits)
                runs = runs_of(texts, len(coded.dictionary))
                parts = [pa.array(runs[1] - limits[runs[0]]), pa.array(runs[2] - runs[1]), pa.array(runs[3])]
                ends = np.append(0, np.cumsum(np.bincount(runs[0], minlength=b - a))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, [name for name, _ in kinds]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts), listed, collapsed_texts(texts, runs, coded.dictionary)],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(find, SCHEMA)


def _strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; the first of several."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.reduce(
        runs, none,
        lambda best, run: F.when(
            best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
        ).otherwise(best),
    )


def run_digest(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: the number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    with_best = found.withColumn("best", _strongest(F.col("runs")))
    return with_best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
