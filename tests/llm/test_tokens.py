"""Token store, piece segmentation and prefix counts against the libraries."""

import json
import random
import zlib
from array import array
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from harbor.llm import sentencepieces, side_by_side, token_counts, token_store
from harbor.llm.pieces import MARK, PieceModel, piece_model
from harbor.llm.queries import BYTE_BPE, END_ID, PIECE_BPE
from harbor.llm.recent import KnownRows, in_rows
from harbor.sources.scratch import scratch_path
from pyspark.sql import functions as F
from tests.llm.tables import AWKWARD, documents, rows_of

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def odd_texts(count=600):
    rng = random.Random(5)
    parts = [*"aábcdeit ñ \n▁0日🎉thin.,'", "  ", "the ", "tion", " ing", "<s>", "don't", "\t", "<0x0A>", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(count)]
    return [*texts, "", " ", "  ", " a", "a ", "\n\n\t x", "a" * 3000, "ab " * 200, " " * 20 + "x", MARK * 3]


def test_byte_ids_equal_the_library():
    texts = odd_texts()
    library = Tokenizer.from_file(BYTE_BPE)
    ids = token_store.TextEncoder(BYTE_BPE).encode(texts)
    assert [list(array("I", one)) for one in ids] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_new_words_are_encoded_in_rows():
    encoder = token_store.TextEncoder(BYTE_BPE)
    words, rows = [f"w{n}x, é{n}" for n in range(5_000)], []
    library = encoder.merging

    class Counted:
        def encode_batch_fast(self, texts, **options):
            rows.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.merging = Counted()
    for _ in range(2):
        [ids] = encoder.encode([" ".join(words)])
        assert list(array("I", ids)) == Tokenizer.from_file(BYTE_BPE).encode(" ".join(words), add_special_tokens=False).ids
    assert 0 < len(rows) < len(words) / 50


def test_pieces_of_words_are_encoded_once():
    encoder = token_store.TextEncoder(BYTE_BPE)
    words, rows = [f"{a}{b}ship" for a in "abcdefghij" for b in "klmnopqrst"], []
    library, merging = Tokenizer.from_file(BYTE_BPE), encoder.merging

    class Counted:
        def encode_batch_fast(self, texts, **options):
            rows.extend(texts)
            return merging.encode_batch_fast(texts, **options)

    encoder.merging = Counted()
    for mark in ["", ",", ".\n", "?!", "1", "\nOn"]:
        text = "on " + " ".join(word + mark for word in words)
        [ids] = encoder.encode([text])
        assert list(array("I", ids)) == library.encode(text, add_special_tokens=False).ids
    assert "".join(rows).count("ship") == len(words)


def test_words_are_cut_as_before_merging():
    rng = random.Random(8)
    below = [chr(code) for code in range(0x250) if code != 32]
    words = [form.format(char) for char in [*below, "\u0250", "\u2003", "日"] for form in ("{0}", "a{0}", "{0}1", "a{0}b", "{0}{0}", "é{0}\n", "1{0}.")]
    words += ["".join(rng.choices([*"aé1,.\n'", "×", "'s", "ab"], k=rng.randint(0, 9))) for _ in range(3_000)] + ["", "x" * 5_000]
    spelled = pa.array([" " + word for word in words])
    pieces, counts = token_store.cut_words(spelled)
    pieces, hard, at = pieces.to_pylist(), token_store.hard_words(spelled).tolist(), 0
    assert sum(counts) == len(pieces) and 0 < sum(hard) < len(words) - 1_000
    split = token_store.TextEncoder(BYTE_BPE).split
    for word, whole, count in zip(spelled.to_pylist(), hard, counts.tolist(), strict=True):
        assert pieces[at : at + count] == ([word] if whole else split(word))
        at += count
    library = Tokenizer.from_file(BYTE_BPE)
    texts = ["on" + word + " on" for word in spelled.to_pylist()] + [" ".join(words)]
    ids = token_store.TextEncoder(BYTE_BPE).encode(texts)
    assert [list(array("I", one)) for one in ids] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("changed", [{"ignore_merges": True}, {"continuing_subword_prefix": "##"}, {"end_of_word_suffix": "</w>"}, {"dropout": 0.1}])
def test_models_that_merge_otherwise_get_whole_texts(tmp_path, changed):
    described = json.loads(Tokenizer.from_file(BYTE_BPE).to_str())
    described["model"] = {**described["model"], **changed, "vocab": {c: n for n, c in enumerate(token_store.byte_characters().values())}, "merges": []}
    described["added_tokens"] = []
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(described))
    assert not token_store.TextEncoder(str(path)).by_word


def test_words_that_come_back_stay():
    made = []

    def make(words):
        made.extend(words.to_pylist())
        sizes = np.array([len(word) for word in words.to_pylist()], np.int64)
        return np.concatenate([np.frombuffer(word.encode(), np.uint8) for word in words.to_pylist()]).astype(np.int32), sizes

    known, rng = KnownRows(make, 50), random.Random(4)
    for number in range(60):
        words = ["the", "of", *{f"{number}-{rng.randint(0, 99)}" for _ in range(20)}, "x" * rng.randint(100, 900)]
        places = known.of(pa.array(words))
        joined = in_rows(known.values, known.begins[places], known.sizes[places])
        assert bytes(joined.tolist()).decode() == "".join(words)
        assert len(known.place) <= 50 + len(words)
    assert made.count("the") < 10


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_store.TextEncoder(path)
    assert not encoder.by_word
    texts = odd_texts(50)
    library = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [list(array("I", one)) for one in encoder.encode(texts)] == [e.ids for e in library]


def stored(spark, rows):
    path = scratch_path(spark, "tokens")
    token_store.write_token_store(documents(spark, rows), path, BYTE_BPE, END_ID)
    return path


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_store(spark, rows):
    path = stored(spark, rows)
    found = token_store.token_digests(token_store.read_token_store(spark, path)).collect()
    library, start = Tokenizer.from_file(BYTE_BPE), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = []
    for doc_id, text, _ in order:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_files_are_in_order_and_selective(spark):
    path = stored(spark, AWKWARD)
    whole = token_store.read_token_store(spark, path)
    one = token_store.read_token_store(spark, path, F.col("doc_id") == 13).collect()
    assert len(one) == 1 and one[0] == whole.filter("doc_id = 13").first()
    plan = token_store.read_token_store(spark, path, F.col("doc_id") == 13).select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,13)" in plan and "ids:array" not in plan.split("== Physical Plan ==")[1]
    parts = spark.read.parquet(path).groupBy("part").agg(F.min("doc_id"), F.max("doc_id")).orderBy("part").collect()
    ends = [(low, high) for _, low, high in parts if low is not None]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_pieces_equal_the_library():
    texts = odd_texts()
    encoder = sentencepieces.WordIds(piece_model(PIECE_BPE))
    assert [list(array("i", one)) for one in encoder.encode(texts)] == LIBRARY.encode(texts)
    for text, ids in zip(texts, LIBRARY.encode(texts), strict=True):
        assert piece_model(PIECE_BPE).decode(ids) == text.replace(MARK, " ")


def test_control_characters_equal_the_library():
    texts = [form.format(chr(code)) for code in [*range(32), *range(127, 160)] for form in ("{0}", "ab{0}cd", "{0}{0} x", "a {0}", "the {0}the")]
    encoder, counter = sentencepieces.WordIds(piece_model(PIECE_BPE)), token_counts.PrefixCounts(piece_model(PIECE_BPE))
    assert [list(array("i", one)) for one in encoder.encode(texts)] == LIBRARY.encode(texts)
    for text in texts:
        assert counter.counts(counter.tables([text])[0]) == [len(LIBRARY.encode(text[:n])) for n in range(len(text) + 1)]
    model = PieceModel(unigram({MARK: -1.0, "a": -2.0, "ab": -3.0}))
    assert model.decode(model.word_ids(MARK + "ab\x00a\x01")) == "ab\x00a\x01"


def test_prefix_counts_equal_encoding_each_prefix():
    counter = token_counts.PrefixCounts(piece_model(PIECE_BPE))
    for text in odd_texts(120)[:126]:
        counts = counter.counts(counter.tables([text])[0])
        assert counts == [len(LIBRARY.encode(text[:n])) for n in range(len(text) + 1)]
        for budget in (0, 1, 5, 20):
            fitting = max(n for n, count in enumerate(counts) if count <= budget)
            if counts[-1] > budget:
                assert counter.cut(counter.tables([text])[0], budget) == fitting


def test_words_are_segmented_side_by_side(monkeypatch):
    model = PieceModel(open(PIECE_BPE, "rb").read())
    one_by_one, calls = model.lattice, []
    monkeypatch.setattr(model, "lattice", lambda word, **options: calls.append(word) or one_by_one(word, **options))
    texts = [*odd_texts(), " ".join(f"w{n}é日 a\nb" for n in range(2_000)), "x" * 200 + " y"]
    sums, tables = token_counts.PrefixCounts(model).totals(pa.array(texts))
    assert sums.tolist() == [len(ids) for ids in LIBRARY.encode(texts)]
    assert calls and all(len(word) > side_by_side.LONGEST for word in calls)
    for n, text in enumerate(texts):
        assert tables(n) == [one_by_one(model.marked(word))[1] for word in model.words(text)]


def test_tables_answer_for_many_keys():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(2**62), 2**62, 4_000))
    table = side_by_side.Table(3_000)
    table.add(keys[:2_000], np.arange(2_000))
    table.add(keys[2_000:3_000], np.arange(2_000, 3_000))
    assert (table.of(keys) == np.append(np.arange(3_000), np.full(len(keys) - 3_000, -1))).all()
    assert len(table.of(keys[:0])) == 0


def unigram(pieces):
    """A unigram model file with the given pieces and scores, byte pieces added."""

    def field(number, data):
        return bytes([number << 3 | 2]) + _varint(len(data)) + data

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + b"\x15" + np.float32(score).tobytes() + bytes([0x18, kind]))

    rows = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3)]
    rows += [piece(f"<0x{n:02X}>", 0, 6) for n in range(256)] + [piece(t, s, 1) for t, s in pieces.items()]
    trainer = bytes([0x18, 1]) + bytes([0x98, 0x02, 1])  # unigram, byte fallback
    return b"".join(rows) + field(2, trainer) + field(3, field(1, b"identity") + bytes([0x18, 1, 0x20, 0]))


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_unigram_finds_the_best_score():
    rng = random.Random(2)
    pieces = {"".join(p): -rng.uniform(1, 9) for size in (1, 2, 3) for p in product("abc" + MARK, repeat=size) if MARK not in p[1:]}
    pieces = {p: s for p, s in pieces.items() if len(p) == 1 or rng.random() < 0.4}
    del pieces["c"]  # so that "c" alone is out of the vocabulary
    model = PieceModel(unigram(pieces))

    def best(word):
        scores = [0.0]
        for end in range(1, len(word) + 1):
            ways = [scores[b] + model.score[model.piece_id[word[b:end]]] for b in range(end) if word[b:end] in model.piece_id]
            if word[end - 1] not in model.piece_id:
                ways.append(scores[end - 1] + model.unknown_score)
            scores.append(max(ways))
        return scores[-1]

    for _ in range(300):
        word = MARK + "".join(rng.choices("abcd", k=rng.randint(0, 12)))
        ids = model.word_ids(word)
        assert model.decode(ids) == word[1:]
        total, bytes_run = 0.0, 0
        for one in ids:
            total += model.unknown_score if one in model.byte_id.values() else model.score[one]
        assert total == pytest.approx(best(word)), (word, bytes_run)


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_encode_and_decode_tables(spark, rows):
    found = sentencepieces.encode_texts(documents(spark, rows), PIECE_BPE, decoded=True)
    assert rows_of(sentencepieces.decode_ids(found, PIECE_BPE)) == rows_of(found)
    expected = []
    for doc_id, text, _ in rows:
        ids = LIBRARY.encode(text or "")
        expected.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids, (text or "").replace(MARK, " ")))
    assert rows_of(found) == sorted(expected, key=repr)


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_count_table(spark, rows):
    found = token_counts.count_tokens(documents(spark, rows), PIECE_BPE, 8, prefixes=True)
    got = rows_of(found, "doc_id", "n_bytes", "n_tokens", "over_limit")
    texts = [(i, t or "") for i, t, _ in rows]
    assert got == sorted(((i, len(t.encode()), len(LIBRARY.encode(t)), len(LIBRARY.encode(t)) > 8) for i, t in texts), key=repr)
    for row in found.collect():
        assert row.prefix_tokens[-1] == row.n_tokens
        assert row.fitting_chars == max(n for n, count in enumerate(row.prefix_tokens) if count <= 8)
