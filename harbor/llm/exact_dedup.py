"""Exact duplicates by content-defined chunk recipes.

Texts are cut into chunks at places that their content sets. Chunks with one hash
are compared by their text, so that a hash names one chunk: it is then a verified
identifier. A text is equal to another when both have the same ordered list of
identifiers, a few long integers. Long texts therefore move once, as chunks that
are deduplicated before the shuffle, and the comparison moves only lists.

All steps are DataFrame functions.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbor.llm.common import ROW, numbered, whole_text, with_row
from harbor.sources.scratch import materialize

MIN_CHUNK, MAX_CHUNK = 512, 4096  # code points

# A chunk ends after a line or a sentence once it has MIN_CHUNK code points, at
# MAX_CHUNK at the latest. The chunks of a text joined are the text.
CHUNK_PATTERN = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:(?<=\n)|(?<=[.!?;:] )|\z)|(?s).{{1,{MAX_CHUNK}}}"

Identifier = Callable[[Column], Column]


def chunks(text: Column) -> Column:
    """The ordered chunks of a text; none for an empty one."""
    return F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(0))


def doubtful_identifiers(docs: DataFrame, text: str, identifier: Identifier) -> DataFrame:
    """Identifiers that stand for more than one chunk text, usually none.

    Equal chunks of a task meet before the shuffle; of each identifier only the
    least and the greatest chunk travel.
    """
    found = docs.select(F.explode(chunks(whole_text(text))).alias("chunk")).select(
        identifier(F.col("chunk")).alias("identifier"), "chunk"
    )
    spans = found.groupBy("identifier").agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
    return spans.filter(F.col("least") != F.col("greatest")).select("identifier")


def chunk_recipes(docs: DataFrame, doc_id: str, text: str, identifier: Identifier) -> DataFrame:
    """One row per row of ``docs``: its number, id, digest and recipe.

    The identifiers that name several chunks are held in one array. For 64-bit
    hashes of ``n`` different chunks about ``n * n / 2 ** 65`` are expected, below
    300 for 100 TB. Such a chunk enters the recipe with its text.
    """
    doubtful = doubtful_identifiers(docs, text, identifier)
    doubtful = doubtful.agg(F.collect_list("identifier").alias("identifiers"))

    def entry(chunk: Column) -> Column:
        name = identifier(chunk)
        return F.struct(name.alias("identifier"), F.when(F.array_contains("doubtful", name), chunk).alias("chunk"))

    body = whole_text(text)
    rows = with_row(docs).select(
        ROW, F.col(doc_id).alias("doc_id"), F.sha2(body, 256).alias("text_sha256"), chunks(body).alias("chunks"),
        doubtful.scalar().alias("doubtful"),
    )
    return rows.select(ROW, "doc_id", "text_sha256", F.transform("chunks", entry).alias("recipe"))


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", identifier: Identifier = F.xxhash64
) -> DataFrame:
    """Class and fate of every row: doc_id, keep_id, group_size, kept, text_sha256, and the row's number.

    Of equal texts the row with the largest id stays. A null text is empty; a null
    id is below all others; of rows that repeat id and text the last read one stays.
    An empty table gives no rows. Other columns are not read.

    Groups are counted before they move, one row per recipe, and those of several rows
    are written. The join of the rows with that table stands alone in its stage, so
    the engine's skew handling can split a recipe that many rows share.
    """
    rows = materialize(chunk_recipes(docs, doc_id, text, identifier), "recipes")
    last = F.max(F.struct("doc_id", ROW))
    groups = rows.groupBy("recipe").agg(last.alias("last"), F.count("*").alias("group_size"))
    groups = materialize(groups.filter("group_size > 1"), "groups")
    own = F.struct("doc_id", ROW)
    return rows.join(groups, "recipe", "left").withColumn("last", F.coalesce("last", own)).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col(ROW) == F.col(f"last.{ROW}")).alias("kept"), "text_sha256", ROW,
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = numbered(docs)
    dropped = exact_duplicates(rows, doc_id, text).filter(~F.col("kept")).select(ROW)
    return rows.join(materialize(dropped, "dropped"), ROW, "left_anti").drop(ROW)
