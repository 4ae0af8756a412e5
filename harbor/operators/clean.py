"""Cleaning of position reports. All steps are narrow: no shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from harbor.defaults import EXCLUDED_SHIP_TYPE, REPORT_COLUMNS, TIMESTAMP_FORMAT
from harbor.functions.moments import parse_wall_clock


def project_columns(raw: DataFrame) -> DataFrame:
    """Keep the used columns of a raw report table under snake_case names."""
    return raw.select([F.col(f"`{name}`").alias(alias) for name, alias in REPORT_COLUMNS.items()])


def drop_incomplete(reports: DataFrame, time_column: str = "timestamp_text") -> DataFrame:
    """Drop reports without vessel, time, place or speed; NaN counts as missing.

    Written as plain null tests, which reach a Parquet scan; ``dropna`` does not.
    """
    for name in ("mmsi", time_column, "latitude", "longitude", "sog"):
        reports = reports.filter(F.col(name).isNotNull())
        if reports.schema[name].dataType in (DoubleType(), FloatType()):
            reports = reports.filter(~F.isnan(name))
    return reports


def cast_numeric(reports: DataFrame) -> DataFrame:
    """Coordinates and speed as double; unreadable text becomes null."""
    return reports.withColumns({name: F.col(name).try_cast("double") for name in ("latitude", "longitude", "sog")})


def parse_timestamp(reports: DataFrame, pattern: str = TIMESTAMP_FORMAT) -> DataFrame:
    """Add ``ts`` read from ``timestamp_text``."""
    return reports.withColumn("ts", parse_wall_clock(F.col("timestamp_text"), pattern))


def valid_coordinates(reports: DataFrame) -> DataFrame:
    """Keep places on the globe, limits included."""
    return reports.filter(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))


def exclude_ship_type(
    reports: DataFrame, ship_type: str = EXCLUDED_SHIP_TYPE, keep_unknown: bool = False
) -> DataFrame:
    """Drop one ship type, and unknown types too unless ``keep_unknown``."""
    differs = F.col("ship_type") != ship_type
    return reports.filter(differs | F.col("ship_type").isNull() if keep_unknown else differs)


def clean_positions(raw: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Raw reports, as read from file, to clean positions.

    Missing values are dropped after the casts as well, so text that is not a
    number or a time goes the way of an empty field.
    """
    reports = raw.transform(project_columns).transform(drop_incomplete)
    reports = reports.transform(cast_numeric).transform(parse_timestamp)
    return clean_typed(reports, keep_unknown)


def clean_typed(positions: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """The same rules for a table that already has typed columns and ``ts``."""
    return (
        positions.transform(drop_incomplete, "ts")
        .transform(valid_coordinates)
        .transform(exclude_ship_type, keep_unknown=keep_unknown)
        .select("mmsi", "ts", "latitude", "longitude", "sog", "ship_type")
    )
