"""Alignment of two tokenizers over a corpus, by inverted pair bitmaps.

Places where tokens of both end cut a text into groups. An occurrence of token a of the
first and one of token b of the second are linked if they share a group. An index holds
for every pair (a, b) which documents of a block have it linked, as compressed bitmap,
and how often, as bit planes of the number of further links. Bitmaps of the parts of a
block are merged by OR; blocks hold different documents, so popcounts add up over them
to a pair's documents and links. These scores go back along the postings to the documents.

Neither tokenizer joins across a single blank or line feed between other characters, so
words are encoded and aligned once while they keep coming back.
"""

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbor.llm.common import keeps, text_slices, trimmed, whole_text
from harbor.llm.token_store import byte_characters
from harbor.sources.scratch import materialize

B_IDS = 20  # bits of an id of the second tokenizer in a pair
BLOCK_CHARS, BLOCK_DOCS = 4_000_000, 1 << 15  # a block is closed at either
REMEMBERED = 200_000  # words
WIDE_GROUP = 1 << 16  # groups of more links are counted by distinct ids
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
BEFORE = " a"  # stands before words that are encoded in a row
ROW_WORDS = 64

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
BITMAPS = "struct<pairs: array<long>, ends: array<int>, bits: binary>"
INDEX_SCHEMA = (
    "block long, doc_ids array<long>, " + ", ".join(f"{name} array<long>" for name in COUNTS)
    + f", digests array<string>, documents {BITMAPS}, planes array<{BITMAPS}>"
)
BITMAPS_TYPE = pa.struct([("pairs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("bits", pa.binary())])


def segments(text: str) -> list[str]:
    """A blank and the text, cut before each single blank or line feed that stands between other characters.

    The blank that begins a segment is left out unless white space follows it.
    """
    if not text:
        return []
    if text.split() == text.replace("\n", " ").split(" "):  # no other white space
        return text.replace("\n", " \n").split(" ")
    return [part[1:] if part[0] == " " and not part[1].isspace() else part for part in CUT.split(" " + text)]


def written(segment: str) -> str:
    """A segment with what begins it."""
    return segment if segment[0] in " \n" else " " + segment


# ---------------------------------------------------------------- words of both tokenizers


@dataclass
class Aligned:
    """Words in a row: counts, links as (pair, times) and groups as text. Of a word whose bytes a tokenizer changes all are empty."""

    changed: np.ndarray
    counts: np.ndarray  # a row each of COUNTS
    starts: np.ndarray  # of the links of each word, and their end
    pairs: np.ndarray
    times: np.ndarray
    groups: pa.Array


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` repeated entries: which entry it is of, and its number there."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


class Aligner:
    """Aligns words by a byte-level tokenizer and a SentencePiece model."""

    def __init__(self, byte_tokenizer: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_tokenizer)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        byte_of = {char: byte for byte, char in byte_characters().items()}
        entries = {number: entry for entry, number in self.first.get_vocab().items()}
        self.bytes_a = [
            bytes(byte_of[char] for char in entry) if set(entry) <= byte_of.keys() else entry.encode()
            for entry in (entries.get(number, "") for number in range(max(entries) + 1))
        ]
        self.bytes_b = [self._piece_bytes(number) for number in range(self.second.get_piece_size())]
        pieces = [self.second.id_to_piece(number) for number in range(self.second.get_piece_size())]
        if any("\n" in piece or "▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("only models whose pieces hold no line feed, and blanks at their begin only")
        self.size_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.names = pa.array([str(number) for number in range(max(len(self.bytes_a), len(self.bytes_b)))])
        self._forget()

    def _piece_bytes(self, number: int) -> bytes:
        piece = self.second.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(number) else piece.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.known = Aligned(
            np.zeros(0, bool), np.zeros((4, 0), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64),
            pa.array([], pa.string()),
        )

    def of(self, words: list[str]) -> tuple[Aligned, np.ndarray]:
        """What is known by now, and where each of the distinct ``words`` stands in it."""
        if len(self.number) > REMEMBERED:
            self._forget()
        new = [word for word in words if word not in self.number]
        if new:
            more, known = self.align(new), self.known
            self.number.update(zip(new, range(len(known.groups), len(known.groups) + len(new)), strict=True))
            self.known = Aligned(
                np.concatenate([known.changed, more.changed]), np.concatenate([known.counts, more.counts], axis=1),
                np.concatenate([known.starts, known.starts[-1] + more.starts[1:]]), np.concatenate([known.pairs, more.pairs]),
                np.concatenate([known.times, more.times]), pa.concat_arrays([known.groups, more.groups]),
            )
        return self.known, np.array([self.number[word] for word in words], np.int64)

    def _encoded(self, words: list[str], before: str = BEFORE) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """Ids of ``words`` by both tokenizers, and for each word whether they keep its bytes; of one that they change no ids.

        Words are encoded in rows, each behind ``before``, as neither tokenizer joins them. Where that does
        not give the bytes back, or a word ends inside a token, fewer are tried, down to single words.
        """
        if not words:
            return [], [], []
        rows = [before + "".join(words[n : n + ROW_WORDS]) for n in range(0, len(words), ROW_WORDS)]
        a = [i for one in self.first.encode_batch_fast(rows, add_special_tokens=False) for i in one.ids]
        b = [i for ids in self.second.encode([row[1:] for row in rows], num_threads=1) for i in ids]
        raw = "".join(rows).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b)):
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            sizes = np.array([len(word.encode()) for word in words], np.int64)
            sizes[::ROW_WORDS] += len(before)
            ends, firsts = np.cumsum(sizes), (np.cumsum(sizes) - sizes)[::ROW_WORDS]
            ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            needed = np.union1d(ends, firsts + len(before)) if before else ends
            if np.isin(needed, ends_a).all() and np.isin(needed, ends_b).all():
                a_stays, b_stays = (
                    at - firsts[np.searchsorted(firsts, at) - 1] > len(before) for at in (ends_a, ends_b)
                )
                return [a[a_stays]], [b[b_stays]], [True] * len(words)
        if len(words) == 1:
            return [], [], [False]
        size = ROW_WORDS if len(words) > ROW_WORDS else len(words) // 2
        parts = [self._encoded(words[n : n + size], before) for n in range(0, len(words), size)]
        return sum((x for x, _, _ in parts), []), sum((x for _, x, _ in parts), []), sum((x for _, _, x in parts), [])

    def align(self, words: list[str]) -> Aligned:
        """Align words as ``segments`` gives them."""
        words = [written(word) for word in words]
        odd = [n for n, word in enumerate(words) if word[1].isspace() or word[-1].isspace()]
        plain = sorted(set(range(len(words))).difference(odd))
        # White space at the ends of a word would run into its neighbours.
        runs = [self._encoded([words[n] for n in plain])]
        runs += [self._encoded([words[n]], "" if words[n][0] == " " else BEFORE) for n in odd]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(ids for run in runs for ids in run[side])]) for side in (0, 1))
        order = np.array(plain + odd, np.int64)
        kept = np.array([same for run in runs for same in run[2]], bool)
        changed = np.zeros(len(words), bool)
        changed[order] = ~kept
        sizes = np.where(kept, [len(words[n].encode()) for n in order], 0)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        word = order[np.searchsorted(np.cumsum(sizes), cuts)] if len(cuts) else cuts
        counts = np.zeros((len(COUNTS), len(words)), np.int64)
        for count, of_group in zip(counts, (in_a, in_b, np.ones(len(cuts), np.int64), in_a * in_b), strict=True):
            np.add.at(count, word, of_group)

        wide = in_a * in_b > WIDE_GROUP
        begin_a, begin_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        of, nth = _spread(np.where(wide, 0, in_b)[group_a])
        pairs = [(a[of] << B_IDS) | b[begin_b[group_a[of]] + nth]]
        times, owner = [np.ones(len(of), np.int64)], [word[group_a[of]]]
        for group in np.flatnonzero(wide):
            left, n_left = np.unique(a[begin_a[group] : begin_a[group] + in_a[group]], return_counts=True)
            right, n_right = np.unique(b[begin_b[group] : begin_b[group] + in_b[group]], return_counts=True)
            pairs.append(((left[:, None] << B_IDS) | right[None, :]).ravel())
            times.append((n_left[:, None] * n_right[None, :]).ravel())
            owner.append(np.full(len(pairs[-1]), word[group]))
        pairs, times, owner = np.concatenate(pairs), np.concatenate(times), np.concatenate(owner)
        if odd or wide.any():
            by_word = np.argsort(owner, kind="stable")
            pairs, times, owner = pairs[by_word], times[by_word], owner[by_word]
        starts = np.searchsorted(owner, np.arange(len(words) + 1))
        return Aligned(changed, counts, starts, pairs, times, self._written(a, b, in_a, in_b, word, counts[2]))

    def _written(self, a, b, in_a, in_b, word, n_groups) -> pa.Array:
        """The groups of each word as ``a1,a2|b1;a3|b2,b3``."""
        left, right = (_joined(self.names.take(pa.array(ids)), sizes, ",") for ids, sizes in ((a, in_a), (b, in_b)))
        groups = pc.binary_join_element_wise(left, right, "|")
        return _joined(groups.take(pa.array(np.argsort(word, kind="stable"))), n_groups, ";")


def _joined(parts: pa.Array, sizes: np.ndarray, between: str) -> pa.Array:
    """Strings joined in runs of the given sizes."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), parts), between)


_aligners: dict[tuple[str, str], Aligner] = {}
keeps("alignment", _aligners.clear)


def aligner(byte_tokenizer: str, piece_model: str) -> Aligner:
    """One per worker process and pair of tokenizers."""
    key = byte_tokenizer, piece_model
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


@dataclass
class AlignedTexts:
    """Texts in a row: a row each of COUNTS, groups as text, and links as (text, pair, times), not yet summed."""

    counts: np.ndarray
    groups: pa.Array
    text: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def align_texts(by: Aligner, texts: list[str]) -> AlignedTexts:
    cut = [segments(text) for text in texts]
    sizes = np.array(list(map(len, cut)), np.int64)
    coded = pa.array([word for words in cut for word in words], pa.string()).dictionary_encode()
    known, rows = by.of(coded.dictionary.to_pylist())
    text, number = np.repeat(np.arange(len(texts)), sizes), np.asarray(coded.indices)
    left_out = np.bincount(text, known.changed[rows][number], len(texts)) > 0
    stays = ~left_out[text]
    text, number, sizes = text[stays], number[stays], np.where(left_out, 0, sizes)
    row = rows[number]
    counts = np.zeros((len(COUNTS), len(texts)), np.int64)
    for n in range(len(COUNTS)):
        np.add.at(counts[n], text, known.counts[n][row])
    joined = _joined(known.groups.take(pa.array(row)), sizes, ";")
    of, nth = _spread((known.starts[1:] - known.starts[:-1])[row])
    link = known.starts[row[of]] + nth
    return AlignedTexts(counts, joined, text[of], known.pairs[link], known.times[link])


# ---------------------------------------------------------------- bitmaps


def compressed(pairs: np.ndarray, slots: np.ndarray, docs: int) -> dict:
    """Bitmaps over ``docs`` places from (pair, slot), sorted and distinct.

    A bitmap is written as 16-bit slots if that is shorter, else as bits.
    """
    firsts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    counts = np.diff(np.append(firsts, len(pairs)))
    wide = (docs + 7) // 8
    dense = 2 * counts >= wide
    ends = np.cumsum(np.where(dense, wide, 2 * counts))
    begins = ends - np.where(dense, wide, 2 * counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    of, nth = _spread(np.where(dense, 0, counts))
    slot, at = slots[firsts[of] + nth], begins[of] + 2 * nth
    out[at], out[at + 1] = slot & 255, slot >> 8
    full = np.flatnonzero(dense)
    if len(full):
        bits = np.zeros((len(full), docs), bool)
        of, nth = _spread(counts[full])
        bits[of, slots[firsts[full][of] + nth]] = True
        out[(begins[full][:, None] + np.arange(wide)[None, :]).ravel()] = np.packbits(bits, axis=1, bitorder="little").ravel()
    return {"pairs": pairs[firsts], "ends": ends.astype(np.int32), "bits": out.tobytes()}


def popcounts(ends: np.ndarray, bits: np.ndarray, docs: int) -> np.ndarray:
    """The number of documents of each bitmap."""
    sizes = np.diff(ends, prepend=0)
    wide = (docs + 7) // 8
    counts = sizes // 2
    full = np.flatnonzero(sizes == wide)
    if len(full):
        inside = bits[((ends[full] - wide)[:, None] + np.arange(wide)[None, :]).ravel()]
        counts[full] = np.bitwise_count(inside).reshape(len(full), wide).sum(axis=1, dtype=np.int64)
    return counts


def expanded(ends: np.ndarray, bits: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the bitmap, slot) of every set bit."""
    sizes = np.diff(ends, prepend=0)
    wide = (docs + 7) // 8
    dense = sizes == wide
    of, nth = _spread(np.where(dense, 0, sizes // 2))
    at = (ends - sizes)[of] + 2 * nth
    slot = bits[at].astype(np.int64) | bits[at + 1].astype(np.int64) << 8
    full = np.flatnonzero(dense)
    if len(full):
        inside = bits[((ends[full] - wide)[:, None] + np.arange(wide)[None, :]).ravel()].reshape(len(full), wide)
        which, where = np.nonzero(np.unpackbits(inside, axis=1, count=docs, bitorder="little"))
        of, slot = np.concatenate([of, full[which]]), np.concatenate([slot, where])
    return of, slot


class Block:
    """Documents that are indexed together."""

    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.digests: list[str] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_ids: list[int | None], texts: list[str], aligned: AlignedTexts) -> None:
        """Links of one pair in one document are merged."""
        key = (aligned.pairs << 15) | (aligned.text + len(self.doc_ids))
        order = np.argsort(key)
        key = key[order]
        firsts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.keys.append(key[firsts])
        self.times.append(np.add.reduceat(aligned.times[order], firsts) if len(key) else aligned.times)
        self.doc_ids += doc_ids
        self.counts.append(aligned.counts)
        self.digests += [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in aligned.groups.to_pylist()]
        self.chars += sum(map(len, texts))

    def row(self, number: int) -> pa.RecordBatch:
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(key)  # parts hold different documents: OR of their bitmaps is their union
        key, times = key[order], times[order]
        pairs, slots, docs = key >> 15, key & (BLOCK_DOCS - 1), len(self.doc_ids)
        planes, further = [], times - 1
        for plane in range(int(further.max(initial=0)).bit_length()):
            has = np.flatnonzero(further >> plane & 1)
            planes.append(compressed(pairs[has], slots[has], docs))
        counts = np.concatenate(self.counts, axis=1)
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int64())] * len(COUNTS), pa.list_(pa.string()), BITMAPS_TYPE, pa.list_(BITMAPS_TYPE)]
        values = [number, self.doc_ids, *counts, self.digests, compressed(pairs, slots, docs), planes]
        names = ["block", "doc_ids", *COUNTS, "digests", "documents", "planes"]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names)


# ---------------------------------------------------------------- tables


def alignment_index(docs: DataFrame, byte_tokenizer: str, piece_model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a block of documents: their counts and digests, and the bitmaps of their pairs."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, block = aligner(byte_tokenizer, piece_model), Block()
        number = TaskContext.get().partitionId() << 33
        for batch in trimmed(batches, "alignment"):
            for a, b in text_slices(batch.column(1)):
                for c in range(a, b, BLOCK_DOCS // 2):
                    d = min(b, c + BLOCK_DOCS // 2)
                    if len(block.doc_ids) + d - c > BLOCK_DOCS:
                        yield block.row(number)
                        block, number = Block(), number + 1
                    ids, texts = (batch.column(n).slice(c, d - c).to_pylist() for n in (0, 1))
                    block.add(ids, texts, align_texts(by, texts))
                    if block.chars >= BLOCK_CHARS:
                        yield block.row(number)
                        block, number = Block(), number + 1
        if block.doc_ids:
            yield block.row(number)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(index, INDEX_SCHEMA)


def _bitmaps(value: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = np.frombuffer(value["bits"].as_py(), np.uint8)
    return np.asarray(value["pairs"].values), np.asarray(value["ends"].values).astype(np.int64), bits


def pair_counts(index: DataFrame) -> DataFrame:
    """pair, a, b, n_docs, n_links, and whether no other pair of ``a`` has more documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            pairs, docs, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n in range(batch.num_rows):
                size = batch.column(0)[n].as_py()
                own, ends, bits = _bitmaps(batch.column(1)[n])
                here = popcounts(ends, bits, size)
                total = here.copy()
                for power, plane in enumerate(batch.column(2)[n].values if len(own) else ()):
                    of, ends, bits = _bitmaps(plane)
                    total[np.searchsorted(own, of)] += popcounts(ends, bits, size) << power
                pairs.append(own)
                docs.append(here)
                links.append(total)
            found, where = np.unique(np.concatenate(pairs), return_inverse=True)
            sums = np.zeros((2, len(found)), np.int64)
            np.add.at(sums[0], where, np.concatenate(docs))
            np.add.at(sums[1], where, np.concatenate(links))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[0]), pa.array(sums[1])], ["pair", "n_docs", "n_links"])

    parts = index.select(F.size("doc_ids").alias("docs"), "documents", "planes")
    parts = parts.mapInArrow(count, "pair long, n_docs long, n_links long")
    pairs = parts.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    a, b = F.shiftright("pair", B_IDS), F.col("pair").bitwiseAND(F.lit((1 << B_IDS) - 1))
    pairs = materialize(pairs.select("pair", a.alias("a"), b.alias("b"), "n_docs", "n_links"), "pairs")
    most = pairs.groupBy("a").agg(F.max("n_docs").alias("most"))
    return pairs.join(most, "a").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("most")).alias("best"))


def _scored(index: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of pairs brought along the postings to the documents."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            columns = {name: batch.column(n) for n, name in enumerate(batch.schema.names)}
            for n in range(batch.num_rows):
                doc_ids = columns["doc_ids"][n].values
                size = len(doc_ids)
                n_best, count_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
                of_pairs = columns["scores"][n].values
                if of_pairs is not None and len(of_pairs):
                    order = np.argsort(np.asarray(of_pairs.field("pair")))
                    n_docs = np.asarray(of_pairs.field("n_docs"))[order]
                    best = np.asarray(of_pairs.field("best").cast(pa.int64()))[order]
                    own, ends, bits = _bitmaps(columns["documents"][n])
                    parts = [(np.arange(len(own)), ends, bits, 1)]
                    for power, plane in enumerate(columns["planes"][n].values):
                        pairs, ends, bits = _bitmaps(plane)
                        parts.append((np.searchsorted(own, pairs), ends, bits, 1 << power))
                    for which, ends, bits, times in parts:
                        of, slot = expanded(ends, bits, size)
                        np.add.at(n_best, slot, best[which[of]] * times)
                        np.add.at(count_sum, slot, n_docs[which[of]] * times)
                counts = [columns[name][n].values for name in COUNTS]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, *counts, pa.array(n_best), pa.array(count_sum), columns["digests"][n].values],
                    ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"],
                )

    postings = index.select("block", F.explode("documents.pairs").alias("pair"))
    known = postings.join(scores.select("pair", "n_docs", "best"), "pair")
    known = known.groupBy("block").agg(F.collect_list(F.struct("pair", "n_docs", "best")).alias("scores"))
    schema = "doc_id long, " + ", ".join(f"{name} long" for name in [*COUNTS, "n_best", "count_sum"]) + ", groups_sha256 string"
    return index.join(known, "block", "left").mapInArrow(score, schema)


def aligned_documents(docs: DataFrame, byte_tokenizer: str, piece_model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: n_a, n_b, n_groups, n_links; n_best, the links whose pair no other pair of its first
    token exceeds in documents; count_sum, the documents of the pairs summed over links; and a digest of the groups.

    A blank and the text are aligned; special strings are plain text. A text that is null or
    empty, or whose bytes a tokenizer changes, has zeros and an empty digest and counts for no pair.
    Rows repeat as they come (each is a document of its own), null ids stay null; extra columns are left behind.
    """
    index = materialize(alignment_index(docs, byte_tokenizer, piece_model, doc_id, text), "alignment")
    return _scored(index, materialize(pair_counts(index), "scores"))


def aligned_groups(docs: DataFrame, byte_tokenizer: str, piece_model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the groups of each text as ``a1,a2|b1;a3|b2,b3``, ids of both tokenizers in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(byte_tokenizer, piece_model)
        for batch in trimmed(batches, "alignment"):
            for a, b in text_slices(batch.column(1)):
                groups = align_texts(by, batch.column(1).slice(a, b - a).to_pylist()).groups
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), groups], ["doc_id", "groups"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(write, "doc_id long, groups string")
