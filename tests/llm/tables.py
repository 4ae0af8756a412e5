"""Small tables with the awkward rows that every operator must stand."""

from pyspark.sql import DataFrame, SparkSession

# Names that operators use themselves come along as extra columns.
DOCUMENTS = (
    "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept string, node int, bands string, "
    "bucket string, root string, score string, lang_pred string, shard string, slot string, ids string, part string, size string"
)
EXTRA = ("x", "x", 7, "x", "x", "x", "x", "x", "x", "x", "x", "x", "x")

PROSE = (
    "the ships of the harbour were waiting for a change of wind and the captain walked along the quay to see whether any "
    "of the men had come back from the town before the evening bell was rung"
)
AWKWARD = [
    (1, PROSE, "en"), (2, PROSE, "en"), (2, PROSE, "en"), (3, None, None), (4, "", "en"), (5, "   \n\t ", None),
    (6, "one two", "en"), (7, "One  two", None), (None, "no id at all here", "en"), (9, "word " * 60_000, "en"),
    (10, "x" * 20_000, None), (11, "日本語 🎉   ñandú", "es"), (12, "12345 !!! 678", None), (12, "other text same id", "fr"),
    (None, PROSE, None), (13, PROSE.upper(), "en"), (14, PROSE + " again", "en"),
]


def documents(spark: SparkSession, rows=AWKWARD) -> DataFrame:
    full = [(i, text, lang, "s", len(text or ""), *EXTRA) for i, text, lang in rows]
    return spark.createDataFrame(full, DOCUMENTS).repartition(3)


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(row) for row in df.select(*(columns or df.columns)).collect()), key=repr)
