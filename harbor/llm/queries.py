"""Registered queries of the text operators, each over its whole table."""

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbor.llm import (
    decontamination,
    exact_dedup,
    language_id,
    near_dedup,
    ngram_join,
    page_text,
    periodic_runs,
    personal_data,
    sentencepieces,
    sharding,
    token_alignment,
    token_counts,
    token_store,
)
from harbor.llm.common import ROW, table
from harbor.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2  # closes each document in the token store
TOKEN_LIMIT = 4096
HELD_OUT = 2  # fold of documents that language ID never learns from
SHARDS = 16


def op1_token_store(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_token_store(table(spark, sf, "documents"), path, BYTE_BPE, END_ID)
    return token_store.token_digests(token_store.read_token_store(spark, path))


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf, "documents")).drop(ROW)


def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepieces.encode_texts(table(spark, sf, "documents"), PIECE_BPE, decoded=True)


def op4_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data.personal_data_digest(personal_data.find_personal_data(table(spark, sf, "documents")))


def op5_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return page_text.extract_pages(table(spark, sf, "pages"))


def op6_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf, "documents")).drop(ROW)


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    part = language_id.part_of(F.col("doc_id"))
    model = language_id.fit_languages(docs.filter(part != HELD_OUT))
    texts = docs.select("doc_id", F.coalesce(part == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return language_id.predict_languages(texts, model).drop("text")


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs, benchmark = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return decontamination.find_benchmark_items(docs, benchmark).drop(ROW)


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), PIECE_BPE, TOKEN_LIMIT)


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf, "documents"), SHARDS)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op11_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf, "documents"))


def planted_places(doc_id: int, words: int) -> np.ndarray | None:
    """One text in ten repeats a stretch of its words from some word on to its end."""
    seed = zlib.crc32(str(doc_id).encode())
    if seed % 10:
        return None
    begin = seed // 10 % words
    period = 1 + (words - begin) // (3 + seed // 10 % 8)
    places = np.arange(words)
    places[begin:] = begin + (places[begin:] - begin) % period
    return places


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf, "documents"), places=planted_places)
    return periodic_runs.run_digest(found)


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return token_alignment.aligned_documents(table(spark, sf, "documents"), BYTE_BPE, PIECE_BPE)


def queries() -> dict[str, Query]:
    return {
        "op1_token_store": op1_token_store,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_personal_data": op4_personal_data,
        "op5_page_text": op5_page_text,
        "op6_near_dedup": op6_near_dedup,
        "op7_language_id": op7_language_id,
        "op8_decontamination": op8_decontamination,
        "op9_token_counts": op9_token_counts,
        "op10_sharding": op10_sharding,
        "op11_ngram_join": op11_ngram_join,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_token_alignment": op13_token_alignment,
    }
