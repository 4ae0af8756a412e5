"""SentencePiece encoding and decoding of whole texts."""

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harbor.llm.common import keeps, text_slices, trimmed, whole_text
from harbor.llm.pieces import PieceModel, piece_model
from harbor.llm.recent import RecentWords


class WordIds:
    """Ids of words, the recent ones remembered."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.words = RecentWords(lambda words: [array("i", model.word_ids(model.marked(word))).tobytes() for word in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native 32-bit integers."""
        ids, ends = self.in_a_row(texts)
        return [ids[begin:end].tobytes() for begin, end in zip(ends[:-1], ends[1:], strict=True)]

    def in_a_row(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each text end, from 0 on."""
        split = [self.model.words(text) for text in texts]
        numbers, values = self.words.coded(split)
        sizes = np.array([len(ids) // 4 for ids in values], np.int64)
        begins, known = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(values), np.int32)
        each = sizes[numbers]
        ends = np.append(0, np.cumsum(each))
        ids = known[np.repeat(begins[numbers] - ends[:-1], each) + np.arange(ends[-1])]
        return ids, ends[np.cumsum([0, *map(len, split)])]


_encoders: dict[str, WordIds] = {}
keeps("pieces", lambda: (_encoders.clear(), piece_model.cache_clear()))


def word_ids(path: str) -> WordIds:
    """One per worker process and model."""
    if path not in _encoders:
        _encoders[path] = WordIds(piece_model(path))
    return _encoders[path]


def encode_texts(
    docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, ids: the ids of the whole text, their number, and their crc32 as little-endian
    unsigned 32-bit integers. ``decoded`` adds ``text`` as the ids give it back.

    A null or empty text has no ids. Rows repeat as they come; no row moves.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields + [("text", pa.string())] * decoded)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = word_ids(model), piece_model(model)
        for batch in trimmed(batches, "pieces"):
            for a, b in text_slices(batch.column(1)):
                ids, ends = encoder.in_a_row(batch.column(1).slice(a, b - a).to_pylist())
                lists = [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [
                    batch.column(0).slice(a, b - a), pa.array(np.diff(ends)),
                    pa.array([zlib.crc32(own.astype("<u4")) for own in lists], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                ]
                if decoded:
                    columns.append(pa.array([pieces.decode(own.tolist()) for own in lists], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids_crc32 long, ids array<int>" + ", text string" * decoded)


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with ``text`` decoded from ``ids``; null ids give null.

    Blanks and the mark that stands for them inside pieces both decode to blanks.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            texts = [pieces.decode(ids.values.to_pylist()) if ids.is_valid else None for ids in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    kept = encoded.drop("text")
    return kept.mapInArrow(decode, T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())]))
