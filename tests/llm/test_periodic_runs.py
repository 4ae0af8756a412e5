"""Runs found in a grammar against a search of every period of every start."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harbor.llm import periodic_runs, queries
from tests.llm.tables import AWKWARD, documents, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def searched(words):
    """(start, length, period) by definition: extend every period from every start."""
    found = {}
    for period in range(1, len(words) // 4 + 1):
        start = 0
        while start + period < len(words):
            stop = start + period
            while stop < len(words) and words[stop] == words[stop - period]:
                stop += 1
            if stop - start >= max(6, 4 * period):
                found.setdefault((start, stop - start), period)
            start = max(start + 1, stop - period + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda run: (run[0], run[2]))


def collapsed(words, runs):
    gone = {at for s, n, q in runs for at in range(s + q, s + n)}
    return " ".join(word for at, word in enumerate(words) if at not in gone)


def changed(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not words:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]


def digest(doc_id, text):
    words = changed(doc_id, WORD.findall(text or ""))
    runs = searched(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    lines = "".join("%d,%d,%d\n" % run for run in runs)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sums = [hashlib.sha256(part.encode()).hexdigest() for part in (lines, collapsed(words, runs))]
    return (doc_id, len(runs), *shown, *sums)


def texts_of(lists):
    ids = np.array([word for words in lists for word in words], np.int64)
    return periodic_runs.Texts(ids, np.append(0, np.cumsum([len(words) for words in lists])).astype(np.int64))


def found_in(lists, vocabulary=300):
    texts = texts_of(lists)
    runs = periodic_runs.runs_of(texts, vocabulary)
    out = [[] for _ in lists]
    for doc, start, stop, period in runs.T.tolist():
        out[doc].append((start - int(texts.limits[doc]), stop - start, period))
    return out


PIECES = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=6)
LISTS = st.lists(PIECES.map(lambda parts: [word for unit, times in parts for word in unit * times]), max_size=5)


@settings(max_examples=400, deadline=None)
@given(LISTS)
def test_runs_by_search(lists):
    assert found_in(lists) == [searched(words) for words in lists]
    assert [periodic_runs.plain_runs(np.array(words, np.int64)) is not None for words in lists] == [True] * len(lists)


def test_shapes():
    fibonacci = [0]
    other = [0, 1]
    while len(other) < 900:
        fibonacci, other = other, other + fibonacci
    nested = ([0] * 7 + [1]) * 6 + ([0] * 7 + [1] + [2]) * 5
    lists = [[], [5], [5] * 5, [5] * 6, [5] * 1000, other, nested, list(range(300)), list(range(75)) * 4, list(range(75)) * 4 + [0]]
    assert found_in(lists) == [searched(words) for words in lists]
    assert found_in([[7] * 100_000]) == [[(0, 100_000, 1)]]


def test_hashes_that_meet(monkeypatch):
    """With hashes that are all alike the words themselves still decide."""
    monkeypatch.setattr(periodic_runs, "mix", lambda values: values * np.uint64(0))
    lists = [[0, 1] * 5 + [2] + [0, 1] * 4, [3] * 9, [0, 0, 1, 1, 0, 1, 0, 0]]
    assert found_in(lists) == [searched(words) for words in lists]


def test_grammar_gives_the_texts_back():
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 4, size).tolist() for size in (0, 1, 2, 50, 700)] + [[1, 2, 3] * 40]
    texts = texts_of(lists)
    grammar = periodic_runs.re_pair(texts, 4)

    def words(symbol):
        if symbol < grammar.base:
            return [int(symbol)]
        return words(grammar.left[symbol - grammar.base]) + words(grammar.right[symbol - grammar.base])

    assert [word for symbol in grammar.symbols for word in words(symbol)] == texts.ids.tolist()
    assert all(len(words(symbol)) == grammar.length[symbol] for symbol in range(grammar.base + len(grammar.left)))
    assert len(grammar.symbols) < len(texts.ids) / 2


ROWS = AWKWARD + [
    (20, "a b c " * 9 + "x " + "b c a " * 9, "en"), (21, "go " * 5, "en"), (22, "go\tgo\ngo\x0bgo\x0cgo\rgo", "en"), (23, "go\x1cgo " * 6, "en"),
    (24, "  " * 8, "en"), (25, "Go go " * 4, None), *[(n, "one two three four five six seven eight nine ten eleven", "en") for n in range(100, 140)],
]


def test_digests(spark):
    found = periodic_runs.run_digest(periodic_runs.periodic_runs(documents(spark, ROWS), places=queries.planted_places))
    assert rows_of(found) == sorted((digest(doc_id, text) for doc_id, text, _ in ROWS), key=repr)


def test_outputs_and_empty_table(spark):
    docs = documents(spark, [(1, "la " * 7 + "end", "en"), (2, None, "en")])
    rows = {row.doc_id: row for row in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(run) for run in rows[1].runs] == [(0, 7, 1)] and rows[1].collapsed == "la end" and rows[1].n_words == 8
    assert rows[2].runs == [] and rows[2].collapsed == "" and rows[2].n_words == 0
    assert periodic_runs.run_digest(periodic_runs.periodic_runs(docs.limit(0))).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((digest(row.doc_id, row.text) for row in docs), key=repr)
    assert rows_of(queries.op12_periodic_runs(spark, folder)) == expected and any(row[1] for row in expected)


def test_words_are_split_as_stated():
    texts = [" a  b\t\x0bc ", "", "\x1ca b c d", "\r\n"]
    words, counts = periodic_runs._words(pa.array(texts))
    assert words.to_pylist() == [word for text in texts for word in WORD.findall(text)]
    assert counts.tolist() == [len(WORD.findall(text)) for text in texts]
