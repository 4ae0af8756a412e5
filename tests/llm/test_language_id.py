"""Cross-parsing against a plain parse, and accuracy on held-out text."""

import random
import zlib

import pytest

from harbor.llm import language_id
from harbor.llm.common import table
from harbor.llm.queries import op7_language_id
from tests.llm.tables import AWKWARD, PROSE, documents, rows_of


def phrases(text, sample):
    """Longest matches from the left, segment by segment; a symbol that the sample lacks is a phrase."""
    count = 0
    for begin in range(0, len(text), language_id.SEGMENT):
        part = text[begin : begin + language_id.SEGMENT]
        at = 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in sample and part[at : at + size] in sample:
                size += 1
            at += size
            count += 1
    return count


@pytest.mark.parametrize("seed", range(3))
def test_phrases(seed):
    rng = random.Random(seed)
    letters = {char: n for n, char in enumerate("abcdeé", 1)}
    coder = language_id.TextCoder(letters)
    samples = ["".join(rng.choices("abcdé ", k=300)), "".join(rng.choices("ab ", k=300))]
    coded = [coder.codes([s])[0] for s in samples]
    texts = ["".join(rng.choices("aAbcdeéz .1 ", k=rng.randint(0, 1500))) for _ in range(30)] + [""]
    codes, sizes = coder.codes(texts)
    found = language_id.count_phrases(codes, sizes, [language_id.automaton_steps(c.tolist()) for c in coded])
    begin = 0
    for n, size in enumerate(sizes):
        own = codes[begin : begin + size].tobytes()
        assert found[:, n].tolist() == [phrases(own, c.tobytes()) for c in coded]
        begin += size


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = op7_language_id(spark, folder)
    truth = table(spark, folder, "documents").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_documents(spark):
    docs = documents(spark)
    model = language_id.fit_languages(docs)
    found = language_id.predict_languages(docs, model)
    assert set(found.columns) == set(docs.columns)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in found.collect()}
    for (doc_id, text), (label, score) in got.items():
        if text is None or not any(c.isalpha() for c in text):
            assert (label, score) == ("und", 0.0)
        else:
            assert label in ("en", "es", "fr"), doc_id
    assert found.count() == len(AWKWARD)


def test_nothing_learned(spark):
    docs = documents(spark, [(1, "text", None), (2, None, "en")])
    model = language_id.fit_languages(docs)
    assert model.languages == []
    found = language_id.predict_languages(docs, model)
    assert rows_of(found, "doc_id", "lang_pred", "score") == [(1, "und", 0.0), (2, "und", 0.0)]
    assert language_id.predict_languages(documents(spark, []), model).count() == 0


def test_labels_are_no_input_of_a_prediction(spark):
    docs = documents(spark, [(n, "the wind and the sea " * 20, "en") for n in range(5)] + [(9, "der wind und die see " * 20, "de")])
    model = language_id.fit_languages(docs)
    plain = language_id.predict_languages(docs.select("doc_id", "text"), model)
    full = language_id.predict_languages(docs.drop("lang", "source"), model)
    assert rows_of(plain, "doc_id", "lang_pred", "score") == rows_of(full, "doc_id", "lang_pred", "score")


def test_letters_by_class():
    """Every code point: a symbol if and only if it is a letter."""
    coder = language_id.TextCoder({"a": 1, "ß": 2})
    points = [code for code in range(0x110000) if not 0xD800 <= code < 0xE000]
    codes = coder.table[points]
    assert [bool(code) for code in codes] == [chr(code).isalpha() for code in points]
    assert coder.table[ord("A")] == coder.table[ord("a")] == 1


def test_no_letter_no_language(spark):
    texts = ["！？", "１２３", "「」", "【】", "㈠", "𝟘𝟙", "🎉 ﷼ 12", "日本", "ß"]
    docs = documents(spark, [(n, text, None) for n, text in enumerate(texts)])
    model = language_id.fit_languages(documents(spark, [(1, PROSE, "en"), (2, "la casa de los libros en la ciudad", "es")]))
    found = dict(rows_of(language_id.predict_languages(docs, model), "doc_id", "lang_pred"))
    assert [found[n] == "und" for n in range(len(texts))] == [not any(char.isalpha() for char in text) for text in texts]


def test_samples_reach_to_the_end_of_a_text(spark):
    """The letters of a label's text stand at its end only, far behind what a prefix would hold."""
    digits = "1 " * 40_000
    docs = documents(spark, [(1, digits + "el perro come la carne " * 2000, "es"), (2, digits + "der hund frisst das fleisch " * 2000, "de")])
    model = language_id.fit_languages(docs)
    tried = documents(spark, [(1, "la carne come el perro", None), (2, "das fleisch frisst der hund", None)])
    assert rows_of(language_id.predict_languages(tried, model), "doc_id", "lang_pred") == [(1, "es"), (2, "de")]


def test_many_labels_keep_their_samples(spark):
    rows = [(n, " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26)}{m}" for m in range(300)), f"l{n}") for n in range(60)]
    model = language_id.fit_languages(documents(spark, rows))
    assert len(model.languages) == 60 and len(set(model.sizes)) < 60 and min(model.sizes) > 500
