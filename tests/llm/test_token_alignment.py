"""Alignment of two tokenizers against a plain count of all links."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from harbor.llm import queries, token_alignment
from tests.llm.tables import AWKWARD, documents, rows_of

A, B = queries.BYTE_BPE, queries.PIECE_BPE
TOKENIZER = Tokenizer.from_file(A)
TOKENIZER.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
ENTRIES = json.loads(TOKENIZER.to_str())["model"]["vocab"]
BYTES = dict(zip(token_alignment.byte_characters().values(), token_alignment.byte_characters(), strict=True))
ENTRY_BYTES = {number: bytes(BYTES[char] for char in entry) for entry, number in ENTRIES.items() if set(entry) <= BYTES.keys()}


def piece_bytes(number):
    piece = PIECES.id_to_piece(number)
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def plain_groups(text):
    """Groups of (A ids, B ids) of a text by the libraries, none if a tokenizer changes its bytes."""
    if not text:
        return []
    a, b = TOKENIZER.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    left, right = [ENTRY_BYTES[i] for i in a], [piece_bytes(i) for i in b]
    whole = (" " + text).encode()
    if b"".join(left) != whole or b"".join(right) != whole:
        return []
    cuts = set(np.cumsum(list(map(len, left))).tolist()) & set(np.cumsum(list(map(len, right))).tolist())
    groups = [([], []) for _ in cuts]
    for side, ids, parts in ((0, a, left), (1, b, right)):
        at, group = 0, 0
        for number, part in zip(ids, parts, strict=True):
            groups[group][side].append(number)
            at += len(part)
            group += at in cuts
    return groups


def plain_rows(texts):
    """Rows of ``aligned_documents`` for (doc_id, text)."""
    groups = [plain_groups(text) for _, text in texts]
    links = [Counter((x, y) for left, right in doc for x in left for y in right) for doc in groups]
    counts = Counter(pair for doc in links for pair in doc)
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (doc_id, _), doc, linked in zip(texts, groups, links, strict=True):
        written = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in doc)
        out.append((
            doc_id, sum(len(left) for left, _ in doc), sum(len(right) for _, right in doc), len(doc), sum(linked.values()),
            sum(n for pair, n in linked.items() if counts[pair] == most[pair[0]]), sum(n * counts[pair] for pair, n in linked.items()),
            hashlib.sha256(written.encode()).hexdigest() if doc else "",
        ))
    return sorted(out, key=repr)


ODD = [
    "one\ntwo\nthree four", "\none", "one\n", "a\n b", "a\t\nb", "x\ry\r\nz.\r", "a\n▁\nb", "\n\nx\ny", "²³. ²", " \nx \n\ny z\n",
    "a  b", " a", "a ", "  ", " ", "\n", "a \n b", "a\n \nb", "x\n\n\ny  z\t\tq", "▁", "a ▁b", "a▁ b", "<|endoftext|>", "end <|endoftext|> here",
    "<s> <unk> </s> <0x41>", "a\x00b", "don't we'll I'm it's", "naïve café 3.14159 1234567", "😀😀 👩‍👩‍👧", "日本語のテキスト 中文", "　wide　space \xa0nb",
    "a\x1c b\x1d \x1ec", "é ́", "� ﻿", "-----" * 40, "aaaa" * 500, "!?" * 300, "0" * 200, "\r\n\r\n x", "a b c " * 50, "ﬁ ½ Ⅷ",
]
ROWS = AWKWARD[:9] + AWKWARD[10:] + [(9, "word " * 500, "en")] + [(100 + n, text, "en") for n, text in enumerate(ODD)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD + [" ", "  ", "the", "'s", "\n", "\t"]), st.text(max_size=8)), max_size=6).map("".join))
def test_groups_by_word(text):
    [written] = token_alignment.align_texts(token_alignment.aligner(A, B), [text]).groups.to_pylist()
    assert written == ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in plain_groups(text))


@pytest.mark.parametrize("chars", [1, 500, token_alignment.BLOCK_CHARS])
def test_rows(spark, monkeypatch, chars):
    monkeypatch.setattr(token_alignment, "BLOCK_CHARS", chars)
    docs = documents(spark, ROWS).repartition(2)
    assert rows_of(token_alignment.aligned_documents(docs, A, B)) == plain_rows([(doc_id, text) for doc_id, text, _ in ROWS])


def test_groups_and_empty_table(spark):
    docs = documents(spark, ROWS)
    found = {row.doc_id: row.groups for row in token_alignment.aligned_groups(docs, A, B).collect() if row.doc_id and row.doc_id >= 100}
    for n, text in enumerate(ODD):
        written = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in plain_groups(text))
        assert found[100 + n] == written
    assert token_alignment.aligned_documents(docs.limit(0), A, B).count() == 0


def test_pair_counts(spark):
    texts = ["the cat", "the the the cat", "the dog", None, "a ▁ the"]
    index = token_alignment.alignment_index(documents(spark, [(n, text, "en") for n, text in enumerate(texts)]), A, B)
    pairs = {(row.a, row.b): (row.n_docs, row.n_links) for row in token_alignment.pair_counts(index).collect()}
    docs, links = Counter(), Counter()
    for text in texts:
        linked = Counter((x, y) for left, right in plain_groups(text) for x in left for y in right)
        links.update(linked)
        docs.update(linked.keys())
    assert pairs == {pair: (docs[pair], links[pair]) for pair in docs}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.sets(st.tuples(st.integers(0, 5), st.integers(0, 299)), max_size=400))
def test_bitmaps(size, entries):
    entries = np.array(sorted((p, s) for p, s in entries if s < size), np.int64).reshape(-1, 2)
    made = token_alignment.compressed(entries[:, 0], entries[:, 1], size)
    ends, bits = made["ends"].astype(np.int64), np.frombuffer(made["bits"], np.uint8)
    of, slot = token_alignment.expanded(ends, bits, size)
    assert sorted(zip(made["pairs"][of].tolist(), slot.tolist(), strict=True)) == [tuple(row) for row in entries.tolist()]
    assert token_alignment.popcounts(ends, bits, size).tolist() == [int((entries[:, 0] == p).sum()) for p in made["pairs"]]


def test_wide_groups(monkeypatch):
    by = token_alignment.Aligner(A, B)
    words = ["the", "日本語" * 30, "naïve", "x" * 400, "😀" * 50]
    narrow = by.align(words)
    monkeypatch.setattr(token_alignment, "WIDE_GROUP", 0)
    wide = by.align(words)
    for n in range(len(words)):
        sums = [Counter(), Counter()]
        for total, made in zip(sums, (narrow, wide), strict=True):
            for pair, times in zip(made.pairs[made.starts[n] : made.starts[n + 1]], made.times[made.starts[n] : made.starts[n + 1]], strict=True):
                total[int(pair)] += int(times)
        assert sums[0] == sums[1] and sums[0].total() == narrow.counts[3][n]


def test_forgotten_words(monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 3)
    by = token_alignment.Aligner(A, B)
    texts = [f"word{n} the other{n % 3}" for n in range(20)]
    parts = [token_alignment.align_texts(by, [text]).groups[0].as_py() for text in texts]
    assert parts == token_alignment.align_texts(token_alignment.Aligner(A, B), texts).groups.to_pylist()


def test_given_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = rows_of(queries.op13_token_alignment(spark, folder))
    assert rows == plain_rows([(row.doc_id, row.text) for row in docs])
