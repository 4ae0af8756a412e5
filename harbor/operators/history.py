"""Tracks kept by day, so that a new day adds to the history without older messages being read.

A span says where a vessel's track begins and ends, how many messages it has and how
far it goes. Spans that follow each other join into one: the gap between them is added.
Joining is associative, so days may be stored in any order, and joined to weeks or
to the whole in any grouping.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbor.defaults import MAX_PIECE_ROWS, SLICE_MINUTES
from harbor.operators.dwell import dwells, stays_near
from harbor.operators.track import VESSEL, VESSEL_DAY, joined_spans, track_spans, with_day

SPAN_SCHEMA = "mmsi long, messages long, km double, latitude double, longitude double, end_lat double, end_lon double, day date"


def day_spans(slow: DataFrame, slice_minutes: int = SLICE_MINUTES, max_piece_rows: int = MAX_PIECE_ROWS) -> DataFrame:
    """The span of each vessel on each day of ``slow``."""
    spans = track_spans(with_day(slow), slice_minutes, max_piece_rows, VESSEL_DAY)
    return spans.select([name for name in SPAN_SCHEMA.replace(",", "").split()[::2]])


def store_days(spans: DataFrame, path: str) -> None:
    """Add days to the history at ``path``, one folder a day. A day that is there already is replaced, others stay."""
    writer = spans.repartition("day").write.partitionBy("day").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The stored spans; a filter on ``day`` reads the folders of those days only."""
    return spark.read.schema(SPAN_SCHEMA).parquet(path)


def joined_days(spans: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Spans of several days of a vessel as one, named by its first day; ``also`` names further columns that part them."""
    key = [*VESSEL, *(also or [])]
    return joined_spans(spans, key, "day", F.min("day").alias("day"))


def history_tracks(spans: DataFrame) -> DataFrame:
    """One row per vessel: ``low_speed_msgs`` and ``total_distance_km``, as ``vessel_tracks`` gives them for all messages."""
    whole = joined_days(spans)
    distance = F.when(F.col("messages") > 1, F.col("km"))
    return whole.select(*VESSEL, F.col("messages").alias("low_speed_msgs"), distance.alias("total_distance_km"))


def stationary_in_history(spans: DataFrame) -> DataFrame:
    """Vessels that dwell and stay near over the whole history, as ``stationary_vessels`` finds them in all messages."""
    vessels = history_tracks(spans).filter(dwells() & stays_near())
    return vessels.select(*VESSEL, "total_distance_km")
