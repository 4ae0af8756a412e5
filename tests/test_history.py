"""Tracks kept by day against the whole computation."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harbor.operators import dwell, history, track

SCHEMA = "mmsi long, ts timestamp_ntz, latitude double, longitude double, sog double, ship_type string"
START = datetime(2025, 4, 20)


def messages(seed, n=900, days=6):
    """A third under one vessel, days without some vessels, messages at midnight, copies."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        vessel = 1 if rng.random() < 1 / 3 else rng.randint(2, 30)
        day = rng.choice([d for d in range(days) if (d + vessel) % 3])
        second = rng.choice([0, 86_399, rng.randint(0, 86_399)])
        row = (vessel, START + timedelta(days=day, seconds=second), round(rng.uniform(55, 55.2), 4), round(rng.uniform(12, 12.2), 4), 0.1, None)
        out += [row] * rng.choice([1, 1, 3])
    return out


def by_vessel(tracks):
    return {r.mmsi: (r.low_speed_msgs, None if r.total_distance_km is None else pytest.approx(r.total_distance_km, abs=1e-6)) for r in tracks.collect()}


@pytest.mark.parametrize("seed,max_rows", [(1, 1_000_000), (2, 5)])
def test_days_in_any_order(spark, tmp_path, seed, max_rows):
    slow = spark.createDataFrame(messages(seed), SCHEMA).repartition(4)
    days = sorted({row[1].date() for row in messages(seed)})
    random.Random(seed).shuffle(days)
    path = str(tmp_path / "history")
    for day in days:
        history.store_days(history.day_spans(slow.filter(F.to_date("ts") == F.lit(day)), max_piece_rows=max_rows), path)
    stored = history.read_days(spark, path)
    assert stored.select("day").distinct().count() == len(days)
    assert by_vessel(history.history_tracks(stored)) == by_vessel(track.vessel_tracks(slow))
    vessels = {r.mmsi for r in history.stationary_in_history(stored).collect()}
    assert vessels == {r.mmsi for r in dwell.stationary_vessels(slow).collect()}


def test_a_day_is_replaced(spark, tmp_path):
    rows, path = messages(3), str(tmp_path / "history")
    slow = spark.createDataFrame(rows, SCHEMA)
    history.store_days(history.day_spans(slow), path)
    day = min(row[1].date() for row in rows)
    fewer = [row for row in rows if row[1].date() != day or row[0] % 2]
    history.store_days(history.day_spans(spark.createDataFrame([row for row in fewer if row[1].date() == day], SCHEMA)), path)
    expected = by_vessel(track.vessel_tracks(spark.createDataFrame(fewer, SCHEMA)))
    assert by_vessel(history.history_tracks(history.read_days(spark, path))) == expected


def test_joining_is_associative(spark):
    """Days to halves to the whole, cut at any day, equals days to the whole."""
    slow = spark.createDataFrame(messages(4), SCHEMA)
    days = history.day_spans(slow)
    whole = {r.mmsi: r.asDict() for r in history.joined_days(days).collect()}
    for cut in (date(2025, 4, 21), date(2025, 4, 23)):
        halves = history.joined_days(days.withColumn("half", F.col("day") < F.lit(cut)), ["half"]).drop("half")
        for row in history.joined_days(halves).collect():
            expected = whole[row.mmsi]
            assert row.asDict() == {**expected, "km": pytest.approx(expected["km"], abs=1e-9)}


def test_only_asked_days_are_read(spark, tmp_path):
    path = str(tmp_path / "history")
    history.store_days(history.day_spans(spark.createDataFrame(messages(5), SCHEMA)), path)
    some = history.read_days(spark, path).filter(F.col("day") >= F.lit(date(2025, 4, 24)))
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().executedPlan().toString()
    late = spark.createDataFrame([row for row in messages(5) if row[1].date() >= date(2025, 4, 24)], SCHEMA)
    assert by_vessel(history.history_tracks(some)) == by_vessel(track.vessel_tracks(late))


def test_single_messages(spark):
    rows = [(1, START, 55.0, 12.0, 0.1, None), (2, START, 55.0, 12.0, 0.1, None), (2, START + timedelta(days=3), 55.0, 13.0, 0.1, None)]
    found = {r.mmsi: r for r in history.history_tracks(history.day_spans(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert found[1].total_distance_km is None and found[2].total_distance_km == pytest.approx(63.78, abs=0.01)
