"""The n-gram join against all pairs by definition."""

import random
import re

import pyarrow as pa
import pytest

from harbor.llm import ngram_join, queries
from tests.llm.tables import AWKWARD, PROSE, documents, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[n : n + 5]) for n in range(len(words) - 4)}


def linked(x, y):
    return bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y)


def plain_rows(rows):
    """doc_id, size and component of (doc_id, text), trying every pair."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for n in range(len(rows)):
        for m in range(n):
            if linked(sets[n], sets[m]):
                root[top(n)] = top(m)
    least = {}
    for n, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(n)] = min(least.get(top(n), doc_id), doc_id)
    return sorted(((doc_id, len(sets[n]), least.get(top(n))) for n, (doc_id, _) in enumerate(rows)), key=repr)


def found(spark, rows):
    return rows_of(ngram_join.ngram_components(documents(spark, [(n, text, "en") for n, text in rows])))


def crowd(rng, copies, words, changes):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def mixed(seed):
    """Crowds of copies at and around the threshold, shared passages, chains, clean texts and short ones."""
    rng = random.Random(seed)
    texts = [text for words, changes in ((60, 3), (200, 9), (45, 1), (300, 20)) for text in crowd(rng, 25, words, changes)]
    passage = " ".join(f"p{n}" for n in range(80))
    texts += [" ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 200))]) + " " + passage for _ in range(40)]
    chain = [f"c{n}" for n in range(400)]
    texts += [" ".join(chain[n : n + 100]) for n in range(0, 300, 9)] + [" ".join(chain[n : n + 99]) for n in range(0, 300, 30)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(150)) for _ in range(30)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(30)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("stars", [0, 3])
def test_all_pairs(spark, monkeypatch, stars):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", stars)
    rows = mixed(stars)
    assert found(spark, rows) == plain_rows(rows)


def test_awkward_rows(spark):
    rows = [(n, text) for n, text, _ in AWKWARD] + [
        (50, "ÄÖ one two"), (51, "äö one two"), (52, "One TWO"), (53, "a\x1cb c d e f"), (54, "a b\x0bc\x0cd\re f"), (55, "a b c d e f"),
        (56, "a b c d"), (57, "a b c d a b c d a b c d"), (58, "a b c d a b c d"), (60, PROSE + " "), (61, PROSE.replace(" ", "\n")),
    ]
    assert found(spark, rows) == plain_rows(rows)


def test_empty_table(spark):
    assert ngram_join.ngram_components(documents(spark).limit(0)).count() == 0
    assert found(spark, [(1, None), (2, ""), (None, " ")]) == plain_rows([(1, None), (2, ""), (None, " ")])


def test_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SEGMENT", 20)
    rows = mixed(7)
    members, links = ngram_join.ngram_links(documents(spark, [(n, text, "en") for n, text in rows]))
    node_of = dict(rows_of(members))
    sets = {node_of[n]: shingles(text) for n, text in rows if n in node_of}
    expected = {
        (min(x, y), max(x, y)): len(sets[x] & sets[y]) for x in sets for y in sets if x < y and linked(sets[x], sets[y])
    }
    got = {(min(row.a, row.b), max(row.a, row.b)): row.common for row in links.collect()}
    assert got == expected and len(expected) > 100


def test_sets_of_texts():
    texts = ["", "One two", "a b c d e f a b c d e", "  x  ", "É é \x85 z w q", "a b c d e"]
    docs, values = ngram_join.shingle_sets(pa.array(texts))
    assert [int((docs == n).sum()) for n in range(len(texts))] == [len(shingles(text)) for text in texts]
    assert len(set(values.tolist())) == len({s for text in texts for s in shingles(text)})


def test_given_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries.op11_ngram_join(spark, folder)) == plain_rows([(row.doc_id, row.text) for row in docs])
