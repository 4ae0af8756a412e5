"""Tracks against a plain walk over sorted messages, however they are cut."""

import math
import random
from datetime import datetime, timedelta
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from harbor.operators import dwell, track

SCHEMA = "mmsi long, ts timestamp_ntz, latitude double, longitude double, sog double, ship_type string"


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2
    a += math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1.0, a)))


def messages(seed, n=400):
    """A third of the messages under one vessel; some share a time or a second, some are identical."""
    rng = random.Random(seed)
    start = datetime(2025, 4, 20, 22, 30)
    rows = []
    for _ in range(n):
        vessel = 1 if rng.random() < 1 / 3 else rng.randint(2, 40)
        row = (
            vessel,
            start
            + timedelta(
                seconds=rng.choice([rng.randint(0, 9000), rng.randint(0, 5), 4000]),
                microseconds=rng.choice([0, 100_000, 900_000, rng.randint(0, 999_999)]),
            ),
            round(rng.uniform(-0.01, 0.01), 4) + 0.0,  # no negative zero
            round(rng.uniform(11.99, 12.01), 4),
            0.1,
            rng.choice(["Cargo", None]),
        )
        rows.extend([row] * rng.choice([1, 1, 1, 2, 7]))
    return rows


def walk(rows):
    """(message, previous place) pairs in path order."""
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3], r[4], r[5] or ""))
    for _, group in groupby(order, key=lambda r: r[0]):
        group = list(group)
        yield from zip(group[1:], [r[2:4] for r in group])


CUTS = [(60, 1_000_000), (60, 20), (60, 1), (7, 30), (1440, 5)]


@pytest.mark.parametrize("minutes,max_rows", CUTS)
def test_vessel_tracks(spark, minutes, max_rows):
    rows = messages(minutes)
    expected = {}
    for row in rows:
        expected.setdefault(row[0], [0, None])[0] += 1
    for row, place in walk(rows):
        expected[row[0]][1] = (expected[row[0]][1] or 0.0) + haversine(*place, row[2], row[3])
    slow = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = track.vessel_tracks(slow, minutes, max_rows).collect()
    assert {r.mmsi: r.low_speed_msgs for r in found} == {v: n for v, (n, _) in expected.items()}
    for row in found:
        assert row.total_distance_km == pytest.approx(expected[row.mmsi][1], abs=1e-9)


@pytest.mark.parametrize("partitions", [1, 2, 7, 60, 400])
def test_previous_position(spark, partitions):
    """A third of the messages under one vessel, ranges of a few rows, copies in several ranges, empty ranges."""
    rows = messages(partitions) + [(3, datetime(2025, 4, 20, 23), 0.001, 12.0, 0.1, "Cargo")] * 300
    slow = spark.createDataFrame(rows, SCHEMA).repartition(5)
    steps = track.previous_position(slow, partitions).collect()
    expected = [(*row, *place) for row, place in walk(rows)]
    assert sorted(map(tuple, steps), key=repr) == sorted(expected, key=repr)


def test_copies_lie_in_several_ranges(spark):
    slow = spark.createDataFrame([(1, datetime(2025, 4, 20), 55.0, 12.0, 0.1, "Cargo")] * 2000, SCHEMA).repartition(5)
    ordered = track.ordered_scan(slow, ["mmsi", *track.PLACE], 8)
    sizes = ordered.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and max(row["count"] for row in sizes) < 1000
    assert track.previous_position(slow, 8).count() == 1999


def test_one_exchange_of_messages(spark):
    slow = spark.createDataFrame(messages(2), SCHEMA)
    scan = track.lagged_within(track.ordered_scan(slow, ["mmsi", *track.PLACE], 8), ["mmsi"], {"latitude": "prev_lat"})
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning(mmsi") == 1
    after = track.previous_position(slow, 8)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in after and "hashpartitioning" not in after


def test_no_and_null_messages(spark):
    assert track.previous_position(spark.createDataFrame([], SCHEMA), 3).count() == 0
    start = datetime(2025, 4, 20)
    rows = [(None, start, 55.0, 12.0, 0.1, None), (None, start + timedelta(hours=1), 55.5, 12.5, 0.1, None), (1, start, 56.0, 13.0, 0.1, None)]
    steps = track.previous_position(spark.createDataFrame(rows, SCHEMA), 3).collect()
    assert [tuple(row) for row in steps] == [(*rows[1], 55.0, 12.0)]


@pytest.mark.parametrize("minutes,max_rows", CUTS)
def test_day_by_day(spark, minutes, max_rows):
    rows = messages(5)
    expected = {}
    for day in {row[1].date() for row in rows}:
        for row, place in walk([r for r in rows if r[1].date() == day]):
            expected[row[0], day] = expected.get((row[0], day), 0.0) + haversine(*place, row[2], row[3])
    assert len({day for _, day in expected}) == 2
    slow = track.with_day(spark.createDataFrame(rows, SCHEMA))
    found = track.vessel_tracks(slow, minutes, max_rows, track.VESSEL_DAY).dropna().collect()
    assert {(r.mmsi, r.day): pytest.approx(r.total_distance_km, abs=1e-9) for r in found} == expected
    steps = track.previous_position(slow, vessel=track.VESSEL_DAY)
    assert steps.count() == sum(len(list(walk([r for r in rows if r[1].date() == d]))) for d in {k[1] for k in expected})


def test_single_message_has_no_distance(spark):
    slow = spark.createDataFrame([(1, datetime(2025, 4, 20), 55.0, 12.0, 0.1, "Cargo")], SCHEMA)
    assert track.vessel_tracks(slow).collect() == [(1, 1, None)]
    assert track.previous_position(slow).count() == 0
    assert dwell.stationary_positions(slow, min_messages=1).count() == 0


def test_identical_messages_travel_nowhere(spark):
    slow = spark.createDataFrame([(1, datetime(2025, 4, 20), 55.0, 12.0, 0.1, "Cargo")] * 5, SCHEMA)
    for max_rows in (1, 1_000_000):
        assert track.vessel_tracks(slow, max_piece_rows=max_rows).collect() == [(1, 5, 0.0)]
    assert dwell.stationary_positions(slow).count() == 5


def test_antipodes_have_a_distance(spark):
    rows = [(1, datetime(2025, 4, 20, 0, 0, i), lat, lon, 0.1, "Cargo") for i, (lat, lon) in enumerate([(90.0, 0.0), (-90.0, 0.0), (0.0, -180.0), (0.0, 0.0)])]
    found = track.vessel_tracks(spark.createDataFrame(rows, SCHEMA)).first()
    assert found.total_distance_km == pytest.approx(math.pi * 6371 * 2.5)


def test_order_inside_a_second_and_a_band(spark):
    """Three times of one second out of latitude order, and one time in a band out of longitude order."""
    start = datetime(2025, 4, 20)
    rows = [(1, start + timedelta(microseconds=m), lat, 12.0, 0.1, "Cargo") for m, lat in ((100_000, 55.02), (500_000, 55.0), (900_000, 55.03))]
    rows += [(2, start, 55.0002, 12.9, 0.1, None), (2, start, 55.0001, 12.1, 0.1, None), (2, start, 55.0002, 12.0, 0.1, None)]
    slow = spark.createDataFrame(rows, SCHEMA)
    whole, cut = (track.vessel_tracks(slow, max_piece_rows=n).orderBy("mmsi").collect() for n in (1_000_000, 1))
    assert [r.total_distance_km for r in cut] == pytest.approx([r.total_distance_km for r in whole])
    assert cut[0].total_distance_km == pytest.approx(5.5597, abs=1e-3)


def test_more_heavy_keys_than_a_broadcast_holds(spark, monkeypatch):
    rows = messages(8)
    slow = spark.createDataFrame(rows, SCHEMA)
    expected = {row.mmsi: row.total_distance_km for row in track.vessel_tracks(slow).collect()}
    monkeypatch.setattr(track, "MAX_BROADCAST_ROWS", 2)
    found = {row.mmsi: row.total_distance_km for row in track.vessel_tracks(slow, 60, 1).collect()}
    assert found == {vessel: pytest.approx(km, abs=1e-9) for vessel, km in expected.items()}
