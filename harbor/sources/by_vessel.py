"""Positions stored by vessel, so that tracks are computed without moving a message again.

The table is bucketed by vessel and stretch and sorted in path order inside a bucket.
The track of an ordinary vessel is one stretch. That of a busy vessel, one with more
messages than a task should sort, has a stretch for each slice of time, so its messages
are spread over the buckets. What happens inside a stretch needs its bucket only; what
happens between stretches needs one row for each. What a busy vessel sends within one slice of time
stays in one bucket; choose ``slice_minutes`` by the most that a bucket may hold.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbor.defaults import MAX_PIECE_ROWS, MIN_SLOW_MESSAGES, SLICE_MINUTES, SLOW_KNOTS
from harbor.functions.moments import time_slice
from harbor.operators.dwell import dwells, low_speed
from harbor.operators.track import PLACE, heavy_keys, joined_spans, piece_spans

BUCKET_KEY = ["mmsi", "stretch"]


def store_by_vessel(
    positions: DataFrame,
    table: str,
    path: str,
    buckets: int,
    slice_minutes: int = SLICE_MINUTES,
    max_piece_rows: int = MAX_PIECE_ROWS,
) -> None:
    """Write ``positions`` as the bucketed table ``table`` with its files at ``path``; an older table of that name is replaced.

    Messages move once, by vessel and stretch. Vessels are counted first, pre-aggregated.
    """
    busy = heavy_keys(positions, ["mmsi"], max_piece_rows)
    stretch = F.lit(0).cast("long")
    if busy is not None:
        positions = positions.join(busy.withColumn("busy", F.lit(True)), "mmsi", "left")
        stretch = F.when(F.col("busy"), time_slice(F.col("ts"), slice_minutes)).otherwise(stretch)
    rows = positions.withColumn("stretch", stretch).drop("busy").repartition(buckets, *BUCKET_KEY)
    writer = rows.write.bucketBy(buckets, *BUCKET_KEY).sortBy(*BUCKET_KEY, *PLACE)
    writer.mode("overwrite").option("path", path).saveAsTable(table)


def read_by_vessel(spark: SparkSession, table: str) -> DataFrame:
    """The stored positions with their ``stretch``."""
    return spark.table(table)


def stored_spans(stored: DataFrame) -> DataFrame:
    """One row per vessel of a stored table: its number of messages, its kilometres, where it begins and ends.

    No message is exchanged: the buckets are what the windows are partitioned by.
    """
    parts = piece_spans(stored.select(*BUCKET_KEY, *PLACE).withColumn("copies", F.lit(1).cast("long")), BUCKET_KEY)
    return joined_spans(parts, ["mmsi"], "stretch")


def stored_distance(stored: DataFrame, min_messages: int = MIN_SLOW_MESSAGES, slow_knots: float = SLOW_KNOTS) -> DataFrame:
    """Distance travelled by each dwelling vessel over its slow messages, as ``vessel_distance`` gives it."""
    spans = stored_spans(low_speed(stored, slow_knots)).withColumnRenamed("messages", "low_speed_msgs")
    return spans.filter(dwells(min_messages) & (F.col("low_speed_msgs") > 1)).select("mmsi", F.col("km").alias("total_distance_km"))
