"""Daily position files in, cleaned positions by day at rest, map features out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harbor.defaults import REPORT_COLUMNS

POSITION_SCHEMA = "mmsi long, ts timestamp_ntz, latitude double, longitude double, sog double, ship_type string"
FILES_PER_DAY = 8

REPORT_TYPES = {
    "MMSI": T.LongType(),
    "# Timestamp": T.StringType(),
    "Latitude": T.DoubleType(),
    "Longitude": T.DoubleType(),
    "SOG": T.DoubleType(),
    "Ship type": T.StringType(),
}


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV files of position reports: one file, a folder of days or a glob.

    Only the header line is read to learn the column order. The used columns get
    declared types, so no pass over the data is spent on inference, range filters
    reach the scan, and an unreadable value becomes null instead of an error.
    Every file must have the same header; Spark checks this while scanning.
    """
    header = spark.read.csv(path, header=True).columns
    missing = [name for name in REPORT_COLUMNS if name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    schema = T.StructType([T.StructField(name, REPORT_TYPES.get(name, T.StringType())) for name in header])
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", enforceSchema=False)


def write_reports(raw: DataFrame, path: str) -> None:
    """Write reports in the layout that ``read_reports`` reads."""
    raw.write.csv(path, header=True)


def write_positions(cleaned: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store cleaned positions as Parquet, one folder per day.

    Text has to be parsed whole on every read; the stored columns are pruned, and
    filters on them and on ``day`` reach the files. ``mode="append"`` adds days.
    """
    days = cleaned.withColumn("day", F.to_date("ts"))
    days.repartition("day", F.pmod(F.xxhash64("mmsi", "ts"), F.lit(FILES_PER_DAY))).write.mode(mode).partitionBy("day").parquet(path)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Stored positions with their ``day``, for whole histories by ``vessel=VESSEL_DAY``."""
    return spark.read.schema(POSITION_SCHEMA + ", day date").parquet(path)


def write_map_features(features: DataFrame, path: str) -> None:
    """Write one JSON object per bubble."""
    features.write.json(path)
