"""Vessels that stay in place: many slow messages, little distance travelled.

The rules judge a vessel over all given messages, as fits one day of them. For a
longer history add ``with_day`` and pass ``vessel=VESSEL_DAY``: then each vessel is
judged day by day.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbor.defaults import (
    MAX_BROADCAST_ROWS,
    MAX_DISTANCE_KM,
    MAX_FAST_MESSAGES,
    MAX_PIECE_ROWS,
    MIN_SLOW_MESSAGES,
    SLICE_MINUTES,
    SLOW_KNOTS,
)
from harbor.operators.lookup import attach
from harbor.operators.track import VESSEL, vessel_tracks


def low_speed(positions: DataFrame, slow_knots: float = SLOW_KNOTS) -> DataFrame:
    """Messages sent below ``slow_knots``."""
    return positions.filter(F.col("sog") < slow_knots)


def low_speed_counts(slow: DataFrame, vessel: list[str] = VESSEL) -> DataFrame:
    """Slow messages per vessel."""
    return slow.groupBy(vessel).agg(F.count("*").alias("low_speed_msgs"))


def dwells(min_messages: int = MIN_SLOW_MESSAGES) -> Column:
    """Rule: enough slow messages."""
    return F.col("low_speed_msgs") >= min_messages


def stays_near(max_distance_km: float = MAX_DISTANCE_KM) -> Column:
    """Rule: little distance travelled. Unknown distance, from a single message, fails."""
    return F.col("total_distance_km") < max_distance_km


def dwelling_vessels(
    slow: DataFrame, min_messages: int = MIN_SLOW_MESSAGES, vessel: list[str] = VESSEL
) -> DataFrame:
    """Vessels with enough slow messages."""
    return low_speed_counts(slow, vessel).filter(dwells(min_messages))


def slow_positions(
    slow: DataFrame,
    min_messages: int = MIN_SLOW_MESSAGES,
    max_broadcast: int = MAX_BROADCAST_ROWS,
    vessel: list[str] = VESSEL,
) -> DataFrame:
    """Slow messages of dwelling vessels, with the vessel's ``low_speed_msgs``."""
    counts = low_speed_counts(slow, vessel)
    return attach(slow, counts, vessel, dwells(min_messages), max_broadcast)


def vessel_total(positions: DataFrame) -> DataFrame:
    """Number of distinct vessels."""
    return positions.agg(F.count_distinct("mmsi").alias("vessels"))


def vessel_distance(
    slow: DataFrame,
    min_messages: int = MIN_SLOW_MESSAGES,
    slice_minutes: int = SLICE_MINUTES,
    max_piece_rows: int = MAX_PIECE_ROWS,
    vessel: list[str] = VESSEL,
) -> DataFrame:
    """Distance travelled by each dwelling vessel over its slow messages."""
    vessels = vessel_tracks(slow, slice_minutes, max_piece_rows, vessel).filter(dwells(min_messages))
    return vessels.select(*vessel, "total_distance_km").dropna()


def stationary_vessels(
    slow: DataFrame,
    min_messages: int = MIN_SLOW_MESSAGES,
    max_distance_km: float = MAX_DISTANCE_KM,
    slice_minutes: int = SLICE_MINUTES,
    max_piece_rows: int = MAX_PIECE_ROWS,
    vessel: list[str] = VESSEL,
) -> DataFrame:
    """Dwelling vessels that travelled less than ``max_distance_km``."""
    distances = vessel_distance(slow, min_messages, slice_minutes, max_piece_rows, vessel)
    return distances.filter(stays_near(max_distance_km))


def stationary_positions(
    positions: DataFrame,
    slow_knots: float = SLOW_KNOTS,
    min_messages: int = MIN_SLOW_MESSAGES,
    max_distance_km: float = MAX_DISTANCE_KM,
    slice_minutes: int = SLICE_MINUTES,
    max_piece_rows: int = MAX_PIECE_ROWS,
    max_broadcast: int = MAX_BROADCAST_ROWS,
    vessel: list[str] = VESSEL,
) -> DataFrame:
    """Slow messages of stationary vessels, with the vessel's message count and distance.

    Two narrow passes measure the vessels; the messages themselves are only
    filtered by a lookup and, unless there are very many vessels, never shuffled.
    """
    slow = low_speed(positions, slow_knots)
    vessels = vessel_tracks(slow, slice_minutes, max_piece_rows, vessel)
    keep = dwells(min_messages) & stays_near(max_distance_km)
    return attach(slow, vessels, vessel, keep, max_broadcast)


def mover_exclusion(
    positions: DataFrame,
    max_fast_messages: int = MAX_FAST_MESSAGES,
    slow_knots: float = SLOW_KNOTS,
    max_broadcast: int = MAX_BROADCAST_ROWS,
    vessel: list[str] = VESSEL,
) -> DataFrame:
    """All messages of vessels with at most ``max_fast_messages`` fast ones."""
    vessels = positions.groupBy(vessel).agg(F.count_if(F.col("sog") >= slow_knots).alias("fast_msgs"))
    return attach(positions, vessels, vessel, F.col("fast_msgs") <= max_fast_messages, max_broadcast)
