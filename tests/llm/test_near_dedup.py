"""Near-duplicates against comparing all pairs, and signatures against the similarity they estimate."""

import random
from collections import defaultdict

import numpy as np
import pytest

from harbor.llm import dart_minhash, near_dedup
from harbor.llm.words import mix, shingles, words_of
from harbor.sources import scratch
from tests.llm.tables import AWKWARD, documents


def runs(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[n : n + 5]) for n in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def classes(rows):
    """Least ids of the classes of all pairs, by position."""
    sets = [runs(text) for _, text, *_ in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or similarity(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    members = defaultdict(list)
    for n, row in enumerate(rows):
        members[find(n)].append(row[0])
    return [min((i for i in members[find(n)] if i is not None), default=None) for n in range(len(rows))]


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"w{rng.randint(0, 10**6)}" for w in words)


def corpus(seed, size=260):
    """A crowd of near copies of one text, chains, exact copies, shared passages, and others."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    passage = " ".join(f"p{n}" for n in range(60))
    rows = []
    for n in range(size):
        kind = rng.random()
        if kind < 0.5:
            text = edited(rng, base, rng.choice([0.0, 0.005, 0.01, 0.02, 0.04]))
        elif kind < 0.6:
            text = " ".join(base[rng.randint(0, 12) :])
        elif kind < 0.8:
            text = passage + " " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 80)))
        else:
            text = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 40)))
        rows.append((n, text, "en"))
    return rows


@pytest.mark.parametrize("rows", [corpus(1), corpus(2), AWKWARD, [], [(1, None, None), (2, "", None), (3, " ", None)]])
def test_classes(spark, rows):
    found = near_dedup.near_classes(documents(spark, rows)).collect()
    expected = classes(rows)
    got = sorted((repr(r.doc_id), repr(r.class_id)) for r in found)
    assert got == sorted((repr(row[0]), repr(c)) for row, c in zip(rows, expected, strict=True))
    kept = [r for r in found if r.kept]
    assert all(r.doc_id == r.class_id for r in kept)


def test_one_row_of_each_class_stays(spark):
    docs = documents(spark)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    texts = sorted(r.text or "" for r in kept.collect())
    assert len(texts) == len(set(texts))
    assert kept.filter("doc_id IN (1, 2, 13)").count() == 1


def test_bound_drops_no_link(spark):
    """Without the first comparisons every pair must come from the open buckets."""
    rows = corpus(3, 120)
    before = near_dedup.DECIDING_ROUNDS
    near_dedup.DECIDING_ROUNDS = 0
    try:
        found = near_dedup.near_classes(documents(spark, rows)).collect()
    finally:
        near_dedup.DECIDING_ROUNDS = before
    assert {r.doc_id: r.class_id for r in found} == {row[0]: c for row, c in zip(rows, classes(rows), strict=True)}


def test_tables_go_when_they_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_root", lambda spark: str(tmp_path))
    codecs = set()
    discard = near_dedup.discard

    def look(table):
        codecs.update(file.split(".")[-2] for file in table.inputFiles() if "/numbered-" in file)
        discard(table)

    monkeypatch.setattr(near_dedup, "discard", look)
    rows = corpus(1, 60)
    found = near_dedup.near_classes(documents(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == {row[0]: c for row, c in zip(rows, classes(rows), strict=True)}
    left = {folder.name.rsplit("-", 1)[0] for folder in tmp_path.iterdir()}
    assert not left & {"numbered", "heads", "members", "open", "sets"} and "signed" in left
    assert codecs == {"zstd"}


def test_words_and_shingles():
    texts = ["", " ", "one", "A b\tc d", "a B c d e", "a b c d e f a b c d e", "É è　ñ 日本 🎉x y"]
    words = words_of(texts)
    assert len(words.doc) == sum(len(t.split()) for t in texts)
    by_word = defaultdict(set)
    for text, value in zip([w.lower() for t in texts for w in t.split()], words.hashes().tolist(), strict=True):
        by_word[text].add(value)
    assert all(len(v) == 1 for v in by_word.values()) and len(set.union(*by_word.values())) == len(by_word)
    doc, found = shingles(words, 5)
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(runs(t)) for t in texts]
    assert set(found[doc == 4]) <= set(found[doc == 5])


@pytest.mark.parametrize("seed", range(4))
def test_signatures_estimate_weighted_similarity(seed):
    rng = np.random.default_rng(seed)
    elements = mix(np.arange(300, dtype=np.uint64))
    a = rng.random(300) * 3
    b = np.where(rng.random(300) < 0.7, a * rng.uniform(0.8, 1.2, 300), rng.random(300))
    one, other = (dart_minhash.signatures(np.zeros(300, int), elements, w, 1, 2048)[0] for w in (a, b))
    assert (one == other).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.05)


def test_signatures_do_not_depend_on_company():
    texts = [row[1] for row in corpus(5, 40)]
    doc, found = near_dedup.text_shingles(texts)
    together = dart_minhash.in_parts(doc, found, np.ones(len(found)), len(texts), 64)
    for n, text in enumerate(texts):
        d, f = near_dedup.text_shingles([text])
        assert (dart_minhash.in_parts(d, f, np.ones(len(f)), 1, 64)[0] == together[n]).all()
