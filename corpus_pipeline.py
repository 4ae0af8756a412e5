"""A training corpus from ``documents``, stage by stage.

Each stage works on all that its predecessor kept. Its result is written as
Parquet and read again as the documents of the next one. Stages before the last
return the columns of ``documents``, extra ones included.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbor.llm import decontamination, language_id, sentencepieces
from harbor.llm.common import free_name, table
from harbor.llm.exact_dedup import drop_exact_duplicates
from harbor.llm.near_dedup import drop_near_duplicates
from harbor.sources.scratch import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BATCH_ROWS = 1000  # documents that Spark hands to a Python worker at once
HELD_OUT = 2  # fold of documents that language ID never learns from


def small_batches(spark: SparkSession) -> None:
    """Documents may be long: hand them to the workers in smaller batches than Spark's default, for the rest of the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter. Columns of any name stay as they are."""
    small_batches(spark)
    model = language_id.fit_languages(docs.filter(language_id.part_of(F.col("doc_id")) != HELD_OUT))
    label, score = free_name(docs, "language"), free_name(docs, "certainty")
    predicted = language_id.predict_languages(docs, model, label=label, score=score)
    return predicted.filter(F.col(label) != language_id.UNKNOWN).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one with the largest id. Null texts are empty; no rows, no result."""
    small_batches(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays, the one with the least id."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text that they decode to."""
    small_batches(spark)
    return sentencepieces.encode_texts(docs, PIECES, decoded=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

# The language model of the first stage and the signatures of the third are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
