"""Vessel tracks cut into pieces, so that no task holds an unbounded track.

Most vessels send few enough messages for one task; their track is one piece. The
track of a busy vessel is cut into time slices: what happens inside a slice needs
only that slice, and what happens between slices needs one row per slice, of which
a vessel has at most as many as the calendar.

A slice may still be crowded, when one vessel number is shared by many senders or
one message is stored over and over. Identical messages of crowded slices are
folded into one row with a number of copies before any of them meet in one task,
and the slices are cut further: by second and by band of latitude, which keeps
path order. Busy vessels and crowded slices are found by pre-aggregated counts.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harbor.defaults import MAX_BROADCAST_ROWS, MAX_PIECE_ROWS, SLICE_MINUTES
from harbor.functions.geo import haversine_km
from harbor.functions.moments import time_micros, time_slice
from harbor.sources.scratch import materialize, materialize_counted

PLACE = ["ts", "latitude", "longitude"]
# Whose track it is: a vessel's, or that of a vessel on one day of a longer history.
VESSEL = ["mmsi"]
VESSEL_DAY = ["mmsi", "day"]
BANDS_PER_DEGREE = 1000
SEQUENCE, PART, EDGE, LAST = "__sequence", "__part", "__edge", "__last"


@dataclass(frozen=True)
class Pieces:
    """Messages with the columns ``key`` of their piece and their number of ``copies``."""

    messages: DataFrame
    key: list[str]


def heavy_keys(rows: DataFrame, key: list[str], max_rows: int) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows, for a join; broadcast if they are few."""
    counts = rows.groupBy(key).agg(F.count("*").alias("rows"))
    heavy, number = materialize_counted(counts.filter(F.col("rows") > max_rows).select(key), "heavy")
    if not number:
        return None
    return F.broadcast(heavy) if number <= MAX_BROADCAST_ROWS else heavy


def with_day(positions: DataFrame) -> DataFrame:
    """Add ``day``, for use with ``VESSEL_DAY``."""
    return positions.withColumn("day", F.to_date("ts"))


def cut_tracks(
    slow: DataFrame,
    slice_minutes: int = SLICE_MINUTES,
    max_piece_rows: int = MAX_PIECE_ROWS,
    vessel: list[str] = VESSEL,
) -> Pieces:
    """Cut the tracks of ``slow`` into pieces small enough for one task."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    busy = heavy_keys(slow, vessel, max_piece_rows)
    if busy is None:
        return Pieces(slow.withColumn("copies", one), vessel)

    moment = F.when(F.col("busy"), time_slice(F.col("ts"), slice_minutes)).otherwise(none)
    sliced = slow.join(busy.withColumn("busy", F.lit(True)), vessel, "left").withColumn("slice", moment)
    key = [*vessel, "slice"]
    crowded = heavy_keys(sliced.filter("busy"), key, max_piece_rows)
    sliced = sliced.select(*slow.columns, "slice")
    if crowded is None:
        return Pieces(sliced.withColumn("copies", one), key)

    place = {
        "moment": time_micros(F.col("ts")),
        "band": F.floor(F.col("latitude") * BANDS_PER_DEGREE),
        "parallel": F.col("latitude"),
        "stretch": F.floor(F.col("longitude") * BANDS_PER_DEGREE),
    }
    whole = {name: (none if name != "parallel" else F.lit(0.0)) for name in place}
    roomy = sliced.join(crowded, key, "left_anti").withColumn("copies", one).withColumns(whole)
    folded = sliced.join(crowded, key, "left_semi").groupBy(sliced.columns).agg(F.count("*").alias("copies"))
    folded = folded.withColumns(place)
    return Pieces(roomy.unionByName(folded), [*key, *place])


def segment_distance(steps: DataFrame) -> DataFrame:
    """Add ``segment_km``, the distance from the previous place."""
    return steps.withColumn(
        "segment_km", haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("latitude"), F.col("longitude"))
    )


def _along(rows: DataFrame, path: WindowSpec, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Add where the row before ended, and whether a row comes first or last on ``path``."""
    steps = rows.withColumns({"prev_lat": F.lag(lat).over(path), "prev_lon": F.lag(lon).over(path)})
    last = F.lead(lat).over(path).isNull()
    return segment_distance(steps.withColumns({"first": F.col("prev_lat").isNull(), "last": last}))


def _ends(lat: str = "latitude", lon: str = "longitude") -> list[Column]:
    """Aggregates: where the first row begins and where the last row ends."""

    def at(which: str, name: str) -> Column:
        return F.max(F.when(F.col(which), F.col(name)))

    return [
        at("first", "latitude").alias("latitude"),
        at("first", "longitude").alias("longitude"),
        at("last", lat).alias("end_lat"),
        at("last", lon).alias("end_lon"),
    ]


def joined_spans(spans: DataFrame, whole: list[str], order: str, *also: Column) -> DataFrame:
    """Stretches of a track that follow each other by ``order`` as one for each ``whole``; ``also`` are further aggregates."""
    path = Window.partitionBy(whole).orderBy(order)
    kilometres = F.col("km") + F.coalesce("segment_km", F.lit(0.0))
    parts = _along(spans, path, "end_lat", "end_lon").groupBy(whole)
    return parts.agg(F.sum("messages").alias("messages"), F.sum(kilometres).alias("km"), *_ends("end_lat", "end_lon"), *also)


def piece_spans(messages: DataFrame, key: list[str]) -> DataFrame:
    """The span of each piece: ``messages`` with the columns ``key`` of their piece and their number of ``copies``."""
    parts = _along(messages, Window.partitionBy(key).orderBy(*PLACE)).groupBy(key)
    return parts.agg(F.sum("copies").alias("messages"), F.sum(F.coalesce("segment_km", F.lit(0.0))).alias("km"), *_ends())


def track_spans(
    slow: DataFrame,
    slice_minutes: int = SLICE_MINUTES,
    max_piece_rows: int = MAX_PIECE_ROWS,
    vessel: list[str] = VESSEL,
) -> DataFrame:
    """One row per vessel: its number of messages, its kilometres, where it begins and where it ends.

    Only the needed columns are shuffled. Pieces are joined up level by level, stretches to
    parallels, those to bands, bands to moments, moments to slices and slices to the track.
    """
    pieces = cut_tracks(slow.select(*vessel, *PLACE), slice_minutes, max_piece_rows, vessel)
    parts = piece_spans(pieces.messages, pieces.key)
    for depth in range(len(pieces.key) - 1, len(vessel) - 1, -1):
        parts = joined_spans(parts, pieces.key[:depth], pieces.key[depth])
    return parts


def vessel_tracks(
    slow: DataFrame,
    slice_minutes: int = SLICE_MINUTES,
    max_piece_rows: int = MAX_PIECE_ROWS,
    vessel: list[str] = VESSEL,
) -> DataFrame:
    """One row per vessel: ``low_speed_msgs`` and ``total_distance_km``.

    The distance is null for a vessel with a single message.
    """
    spans = track_spans(slow, slice_minutes, max_piece_rows, vessel)
    distance = F.when(F.col("messages") > 1, F.col("km"))
    return spans.select(*vessel, F.col("messages").alias("low_speed_msgs"), distance.alias("total_distance_km"))


# ---------------------------------------------------------------- previous places by one ordered scan


def ordered_scan(rows: DataFrame, key: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` in order of ``key``, cut into as many ranges, each sorted within its partition.

    Only this exchange moves rows. The range partitioner draws the limits from a sample.
    A number of the row within its input comes last, so that even identical rows may lie in several ranges.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*key, *[name for name in rows.columns if name not in key], SEQUENCE]
    ranges = rows.withColumn(SEQUENCE, F.monotonically_increasing_id()).repartitionByRange(partitions, *order)
    return ranges.sortWithinPartitions(*order).drop(SEQUENCE)


def lagged_within(ordered: DataFrame, vessel: list[str], values: dict[str, str]) -> DataFrame:
    """Add to each row of a sorted scan, under new names, the values of the row before in its partition.

    They are null where the row before has another vessel or lies in another partition.
    PART numbers the partition and EDGE marks its last row. Batches pass one by one; of
    those that have passed only the last row is kept.
    """

    def lag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, needed = TaskContext.get().partitionId(), [*vessel, *values]
        kept: pa.RecordBatch | None = None
        waiting: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                yield _marked(waiting, part, False)
            rows = pa.Table.from_batches([batch.select(needed)])
            first = rows.slice(0, 1) if kept is None else pa.Table.from_batches([kept])
            before = pa.concat_tables([first, rows.slice(0, batch.num_rows - 1)])
            same = pa.array(np.arange(batch.num_rows) >= (kept is None))
            for name in vessel:
                both_null = pc.and_(pc.is_null(rows[name]), pc.is_null(before[name]))
                same = pc.and_(same, pc.or_(pc.fill_null(pc.equal(rows[name], before[name]), False), both_null))
            lagged = [pc.if_else(same, before[name], None).combine_chunks() for name in values]
            waiting = pa.RecordBatch.from_arrays([*batch.columns, *lagged], [*batch.schema.names, *values.values()])
            kept = batch.select(needed).slice(batch.num_rows - 1, 1)
        if waiting is not None:
            yield _marked(waiting, part, True)

    added = [T.StructField(new, ordered.schema[name].dataType) for name, new in values.items()]
    marks = [T.StructField(PART, T.IntegerType()), T.StructField(EDGE, T.BooleanType())]
    return ordered.mapInArrow(lag, T.StructType([*ordered.schema.fields, *added, *marks]))


def _marked(batch: pa.RecordBatch, part: int, last: bool) -> pa.RecordBatch:
    edge = np.zeros(batch.num_rows, bool)
    edge[-1] = last
    columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(edge)]
    return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, PART, EDGE])


def previous_position(slow: DataFrame, partitions: int | None = None, vessel: list[str] = VESSEL) -> DataFrame:
    """Each message with the vessel's previous place; a vessel's first message is dropped.

    One exchange puts the messages in order of vessel, time and place; a pass over each
    partition takes the place before and writes the result. What a partition's first message
    lacks is the last place of the partition before it: one row per partition, read back and
    looked up by its number. No vessel is counted first, and a vessel may fill any number of
    partitions.
    """
    ordered = ordered_scan(slow, [*vessel, *PLACE], partitions)
    steps = lagged_within(ordered, vessel, {"latitude": "prev_lat", "longitude": "prev_lon"})
    steps = materialize(steps, "steps")
    # One row per partition that has any; ``lead`` passes over empty ones.
    ends = steps.filter(EDGE).select(F.struct(*vessel, *PLACE).alias(LAST), F.lead(PART).over(Window.orderBy(PART)).alias(PART))
    steps = steps.join(F.broadcast(ends), PART, "left")
    own = F.lit(True)
    for name in vessel:
        own &= F.col(name).eqNullSafe(F.col(f"{LAST}.{name}"))
    for name, place in (("prev_lat", "latitude"), ("prev_lon", "longitude")):
        steps = steps.withColumn(name, F.coalesce(name, F.when(own, F.col(f"{LAST}.{place}"))))
    return steps.dropna(subset=["prev_lat", "prev_lon"]).select(*slow.columns, "prev_lat", "prev_lon")
