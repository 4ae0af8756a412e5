"""Positions derived from an ``events`` table, for data sets without position files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbor.sources.reports import POSITION_SCHEMA
from harbor.sources.scratch import exists, scratch_path

# One text for Spark and for the SQL that checks it.
POSITIONS_SQL = """
SELECT 219000000 + user_id AS mmsi,
       CASE WHEN event_id % 101 = 0 THEN NULL ELSE date_trunc('second', ts) END AS ts,
       CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 83 = 0 THEN 91.0E0
            ELSE (54604003 + 500000 * (user_id % 3) + CASE WHEN user_id % 3 = 2 THEN 120000 ELSE 40000 END * (user_id % 2)
                 + 10 * (20 + 60 * (user_id % 5)) * ((event_id * 7919) % 201 - 100) / 100.0E0) / 1000000.0E0 END AS latitude,
       CASE WHEN event_id % 79 = 0 THEN 181.0E0
            ELSE (8504003 + 1500000 * (user_id % 3)
                 + 10 * (20 + 60 * (user_id % 5)) * ((event_id * 104729) % 201 - 100) / 100.0E0) / 1000000.0E0 END AS longitude,
       CASE WHEN event_id % 89 = 0 THEN NULL
            WHEN user_id % 8 = 7 THEN 5 + (event_id % 100) / 10.0E0
            WHEN user_id % 8 = 6 AND event_id % 12 <> 0 THEN 2.5E0
            ELSE (event_id % 13) / 20.0E0 END AS sog,
       CASE WHEN user_id % 11 = 10 THEN NULL WHEN user_id % 13 = 12 THEN 'SAR'
            WHEN user_id % 5 = 0 THEN 'Cargo' WHEN user_id % 5 = 1 THEN 'Tanker' WHEN user_id % 5 = 2 THEN 'Fishing'
            WHEN user_id % 5 = 3 THEN 'Passenger' ELSE 'Tug' END AS ship_type
FROM {events}
"""


def positions_from_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """Typed, uncleaned positions from ``events.parquet``."""
    events = spark.read.parquet(f"{data_dir}/events.parquet")
    positions = spark.sql(POSITIONS_SQL, events=events)
    return positions.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_stored: dict[tuple[str, str], str] = {}


def positions_table(spark: SparkSession, data_dir: str) -> DataFrame:
    """The derived positions as a table at rest, written once per application, and again after a release.

    This stands for the stored position files of real use: later scans read plain
    columns, prune them, and push filters into the file reader, where filters over
    the derivation would evaluate its long expressions many times.
    """
    key = (spark.sparkContext.applicationId, data_dir)
    if key not in _stored or not exists(spark, _stored[key]):
        path = scratch_path(spark, "positions")
        positions_from_events(spark, data_dir).write.parquet(path)
        _stored[key] = path
    return spark.read.schema(POSITION_SCHEMA).parquet(_stored[key])


def raw_reports(positions: DataFrame) -> DataFrame:
    """Positions in the columns and text time format of a daily position file."""
    return positions.select(
        F.col("mmsi").alias("MMSI"),
        F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("# Timestamp"),
        F.col("latitude").alias("Latitude"),
        F.col("longitude").alias("Longitude"),
        F.col("sog").alias("SOG"),
        F.col("ship_type").alias("Ship type"),
    )
