"""Token ids in Parquet, one list per document, in ascending document order.

Layout of a store: one file per range of ids, rows ascending by id. ``ids`` is a
dictionary-encoded list (a vocabulary fits one dictionary page, so an id takes
about two bytes), the other columns are delta-encoded. Row groups and pages are
of set size and Parquet writes page indexes, so that a filter on ``doc_id``
reads the pages of those rows only, and a read of ``n_tokens`` touches no id.
"""

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harbor.llm.common import keeps, text_slices, trimmed, whole_text
from harbor.llm.recent import KnownRows, in_rows

STORE_SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#first": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
BATCH_BYTES = 3_000_000  # text encoded at once
PIECES = 320_000  # remembered pieces of words
ROW_PARTS = 64  # parts of words given to the library in a row
ROWS_AT_ONCE = 64  # rows in one call
BETWEEN = 0xFF  # the byte between them; no UTF-8 has it


# Fixed value: how byte-level tokenizers split a text before merging.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ABOVE_LATIN = "[^\\x{0}-\\x{24F}]"  # up to there the classes of characters are the same in every Unicode version


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if it can be printed, else the next one from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [byte for byte in range(256) if byte not in printed]
    return {byte: chr(byte) for byte in printed} | {byte: chr(256 + n) for n, byte in enumerate(others)}


LETTER, DIGIT, MARK, FEED, BLANK, HARD = range(6)


@cache
def byte_classes() -> np.ndarray:
    """Classes of bytes, by which words are cut; ``HARD`` are those by which it cannot be told where to cut.

    The bytes of letters from U+00C0 to U+023F count as letters. An apostrophe may begin an ending (``'s``).
    """
    classes = np.full(256, HARD, np.uint8)
    classes[33:127] = [LETTER if char.isalpha() else DIGIT if char.isdigit() else MARK for char in map(chr, range(33, 127))]
    classes[0x80:0xC0] = classes[0xC3:0xC9] = LETTER
    classes[ord("\n")], classes[ord(" ")], classes[ord("'")] = FEED, BLANK, HARD
    return classes


def cut_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words, each with its blank, cut as they are before merging, and the number of pieces of each. Hard ones stay whole."""
    offsets, data = bytes_of(words)
    classes = byte_classes()[data]
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets] = True
    of_word = np.cumsum(starts, dtype=np.int32) - 1
    whole = np.zeros(len(words) + 1, bool)
    whole[of_word[np.flatnonzero(hard_bytes(data, classes))]] = True
    cuts = np.append(False, classes[1:] != classes[:-1])
    cuts[offsets[:-1]] = False
    cuts[offsets[:-1][np.diff(offsets) > 1] + 1] = False
    at = np.flatnonzero(cuts)
    at = at[~whole[of_word[at]]]
    starts[at] = True
    pieces = pa.py_buffer(np.flatnonzero(starts).astype(np.int32))
    counts = 1 + np.bincount(of_word[at], minlength=len(words))
    return pa.StringArray.from_buffers(int(counts.sum()), pieces, pa.py_buffer(data)), counts


def hard_words(words: pa.Array) -> np.ndarray:
    """Which of the words, or pieces of words, are hard to cut."""
    offsets, data = bytes_of(words)
    hard = hard_bytes(data, byte_classes()[data])
    before = np.append(0, np.cumsum(hard, dtype=np.int32))
    return before[offsets[1:]] > before[offsets[:-1]]


def hard_bytes(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Bytes of no plain class, of the signs U+00D7 and U+00F7 among the letters, and line feeds after white space."""
    hard = classes == HARD
    hard[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    hard[1:] |= (classes[1:] == FEED) & ((classes[:-1] == FEED) | (classes[:-1] == BLANK))
    return hard


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, with the end of the last, and the bytes of all words. No null."""
    _, offsets, data = words.buffers()
    if not len(words) or data is None:
        return np.zeros(len(words) + 1, np.int32), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


class TextEncoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level tokenizer never joins across a single blank: the blank begins the
    next word. The words of a slice of texts are cut into the pieces that are merged by
    themselves; a piece is encoded by the library once and remembered, many different ones
    in a row. Words that the classes of bytes do not tell how to cut are remembered whole.
    Texts with two blanks in a row or with an added token, and all texts of other kinds
    of tokenizers, are given to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        model, splitter = described["model"], described.get("pre_tokenizer") or {}
        characters = byte_characters()
        entries = self.tokenizer.get_vocab()
        self.by_word = (
            described.get("normalizer") is None
            and model["type"] == "BPE"
            and not any(model.get(key) for key in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True)
            and not splitter.get("add_prefix_space", True)
            and set(characters.values()) <= entries.keys()
            and [entry for entry in entries if characters[BETWEEN] in entry] == [characters[BETWEEN]]
        )
        self.whole = ["  "] + [token["content"] for token in described.get("added_tokens", [])]
        self.split = regex.compile(BYTE_LEVEL_SPLIT).findall
        # The model alone, on parts that are spelled in byte characters already. No merge crosses the byte between them.
        self.merging = Tokenizer(self.tokenizer.model)
        self.spelling = np.array([ord(characters[byte]) for byte in range(256)], "<u4")
        self.between = entries.get(characters[BETWEEN])
        self.pieces = KnownRows(self._piece_ids, PIECES)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        ids, ends = self.in_a_row(pa.array(texts, pa.string()))
        return [ids[begin:end].astype("<i4").tobytes() for begin, end in zip(ends[:-1], ends[1:], strict=True)]

    def in_a_row(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each text end, from 0 on."""
        if not self.by_word:
            ids, sizes = self._library(texts.to_pylist())
            return ids, np.append(0, np.cumsum(sizes))
        whole = reduce(pc.or_, [pc.match_substring(texts, mark) for mark in self.whole])
        plain = texts.filter(pc.invert(whole))
        split = pc.split_pattern(plain, " ")
        words, starts = split.values, np.asarray(split.offsets)[:-1]
        after = np.ones(len(words), bool)
        after[starts] = False
        coded = words.filter(pa.array(after)).dictionary_encode()
        known, known_sizes = self._words(coded.dictionary)
        alone, sizes_alone = self._library(words.take(pa.array(starts)).to_pylist() + texts.filter(whole).to_pylist())
        # Rows: words after a blank, first words of texts, whole texts.
        values, sizes = np.concatenate([known, alone]), np.concatenate([known_sizes, sizes_alone])
        begins = np.cumsum(sizes) - sizes
        rows, of_whole = np.empty(len(words), np.int64), np.asarray(whole)
        rows[after] = np.asarray(coded.indices)
        rows[starts] = len(known_sizes) + np.arange(len(plain))
        counts = np.ones(len(texts), np.int64)
        counts[~of_whole] = np.diff(np.asarray(split.offsets))
        last = np.cumsum(counts)
        order = np.empty(int(last[-1]) if len(last) else 0, np.int64)
        in_plain = np.repeat(~of_whole, counts)
        order[in_plain] = rows
        order[~in_plain] = len(known_sizes) + len(plain) + np.arange(len(texts) - len(plain))
        each = sizes[order]
        return in_rows(values, begins[order], each), np.append(0, np.cumsum(each))[np.append(0, last)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words after a blank in a row, and how many are of each."""
        pieces, counts = cut_words(pc.binary_join_element_wise("", words, " "))
        coded = pieces.dictionary_encode()
        places = self.pieces.of(coded.dictionary)[np.asarray(coded.indices)]
        sizes = self.pieces.sizes[places]
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return in_rows(self.pieces.values, self.pieces.begins[places], sizes), np.diff(ends)

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and how many are of each."""
        above = np.asarray(pc.match_substring_regex(pieces, ABOVE_LATIN))
        hard = hard_words(pieces) & ~above
        # Plain pieces, parts of hard ones, pieces with characters above those classes: these are given to the library as texts.
        parts = [self.split(piece) for piece in pieces.filter(pa.array(hard)).to_pylist()]
        plain = pieces.filter(pa.array(~hard & ~above))
        coded = pa.concat_arrays([plain, pa.array(chain.from_iterable(parts), pa.string())]).dictionary_encode()
        values, sizes = self._part_ids(coded.dictionary)
        alone, sizes_alone = self._library(pieces.filter(pa.array(above)).to_pylist())
        counts = np.ones(len(pieces), np.int64)
        counts[hard] = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(np.repeat(hard + 2 * above, counts), kind="stable")
        rows = np.empty(len(order), np.int64)
        rows[order] = np.append(np.asarray(coded.indices), len(sizes) + np.arange(len(sizes_alone)))
        values, sizes = np.concatenate([values, alone]), np.concatenate([sizes, sizes_alone])
        each = sizes[rows]
        ends = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(counts))]
        return in_rows(values, (np.cumsum(sizes) - sizes)[rows], each), np.diff(ends)

    def _part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts in a row, and how many are of each; many go to the library in one call."""
        bounds = pa.array([*range(0, len(parts), ROW_PARTS), len(parts)], pa.int32())
        rows = pc.binary_join(pa.ListArray.from_arrays(bounds, parts.cast(pa.binary())), bytes([BETWEEN]))
        spelled = [self.spelling[np.frombuffer(row, np.uint8)].tobytes().decode("utf-32-le") for row in rows.to_pylist()]
        found = []
        for begin in range(0, len(spelled), ROWS_AT_ONCE):
            encoded = self.merging.encode_batch_fast(spelled[begin : begin + ROWS_AT_ONCE], add_special_tokens=False)
            found += [np.array([*one.ids, self.between], np.int32) for one in encoded]
        ids = np.concatenate([np.zeros(0, np.int32), *found])
        between = ids == self.between
        return ids[~between], np.diff(np.flatnonzero(between), prepend=-1) - 1

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many are of each."""
        encoded = [one.ids for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum())), sizes


@cache
def text_encoder(path: str) -> TextEncoder:
    """One encoder per worker process."""
    return TextEncoder(path)


keeps("tokens", text_encoder.cache_clear)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of a store: ids of every whole text and ``end_id``, ranges of documents in ascending order.

    ``part`` numbers the range, ``first`` counts the ids before the document in its range.
    A null text is empty and gives ``end_id`` alone; a null id comes first.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = text_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in trimmed(batches, "tokens"):
            for a, b in text_slices(batch.column(1), BATCH_BYTES):
                found, ends = encoder.in_a_row(batch.column(1).slice(a, b - a))
                ids = np.insert(found, ends[1:], end_id)
                ends = ends + np.arange(b - a + 1)
                counts = np.diff(ends)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)),
                    pa.array(first + ends[:-1]), pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                ], schema=schema)
                first += int(ends[-1])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    ranges = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ranges.mapInArrow(encode, STORE_SCHEMA)


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, **columns: str) -> None:
    """Encode ``docs`` into a new store at ``path``. An empty table gives an empty store."""
    encode_documents(docs, tokenizer, end_id, **columns).write.options(**LAYOUT).parquet(path)


def read_token_store(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """Documents of a store with ``start``, the number of ids of all documents before them.

    ``keep`` filters on the stored columns and reaches the file reader. The counts of
    the ranges, one row per written range, are summed from the metadata columns alone.
    """
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    ranges = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rows = store if keep is None else store.filter(keep)
    return rows.join(F.broadcast(ranges), "part").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


def token_digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens of stored documents and the crc32 of their ids, little-endian unsigned 32-bit."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = np.asarray(lists.flatten()).astype("<u4", copy=False)
            ends = np.cumsum(np.asarray(lists.value_lengths()))
            data = memoryview(ids).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    columns = stored.select("doc_id", "start", "n_tokens", "ids")
    return columns.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
