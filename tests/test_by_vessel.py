"""Positions stored by vessel against tracks of loose positions."""

import random
from datetime import datetime, timedelta

import pytest

from harbor.operators import dwell, track
from harbor.sources import by_vessel

SCHEMA = "mmsi long, ts timestamp_ntz, latitude double, longitude double, sog double, ship_type string"
START = datetime(2025, 4, 20)


def messages(seed, n=1500):
    """A third under one vessel, fast and slow, copies, some at one time."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        vessel = 1 if rng.random() < 1 / 3 else rng.randint(2, 40)
        at = START + timedelta(seconds=rng.choice([rng.randint(0, 80_000), 40_000]))
        row = (vessel, at, round(rng.uniform(55, 55.02), 4), round(rng.uniform(12, 12.02), 4), rng.choice([0.1, 0.2, 3.0]), None)
        out += [row] * rng.choice([1, 1, 2])
    return out


def stored(spark, tmp_path, rows, name, buckets=5, **cut):
    by_vessel.store_by_vessel(spark.createDataFrame(rows, SCHEMA).repartition(4), name, str(tmp_path / name), buckets, **cut)
    return by_vessel.read_by_vessel(spark, name)


@pytest.mark.parametrize("minutes,max_rows", [(60, 1_000_000), (60, 30), (5, 1)])
def test_distances(spark, tmp_path, minutes, max_rows):
    rows = messages(max_rows)
    table = stored(spark, tmp_path, rows, f"stored_{minutes}_{max_rows}", slice_minutes=minutes, max_piece_rows=max_rows)
    expected = dwell.vessel_distance(dwell.low_speed(spark.createDataFrame(rows, SCHEMA)))
    found = {r.mmsi: r.total_distance_km for r in by_vessel.stored_distance(table).collect()}
    assert found == {r.mmsi: pytest.approx(r.total_distance_km, abs=1e-9) for r in expected.collect()}
    assert sorted(map(tuple, table.drop("stretch").collect()), key=repr) == sorted(rows, key=repr)


def test_messages_are_not_exchanged(spark, tmp_path):
    table = stored(spark, tmp_path, messages(3), "stored_plan", max_piece_rows=30)
    inner = track.piece_spans(table.selectExpr("mmsi", "stretch", "ts", "latitude", "longitude", "1L AS copies"), by_vessel.BUCKET_KEY)
    assert "Exchange" not in inner._jdf.queryExecution().executedPlan().toString()
    whole = by_vessel.stored_distance(table)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(mmsi" in whole


def test_busy_vessels_are_spread(spark, tmp_path):
    rows = [row for row in messages(4) if row[1] != START + timedelta(seconds=40_000)]  # what shares one slice shares a bucket
    table = stored(spark, tmp_path, rows, "stored_spread", buckets=8, slice_minutes=30, max_piece_rows=50)
    parts = table.filter("mmsi = 1").selectExpr("input_file_name() AS file").groupBy("file").count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < sum(r["count"] for r in parts) / 2
    assert table.filter("mmsi > 1 AND stretch = 0").count() > 0


def test_a_table_is_replaced_and_may_be_empty(spark, tmp_path):
    assert by_vessel.stored_distance(stored(spark, tmp_path, messages(5), "stored_again")).count() > 0
    assert by_vessel.stored_distance(stored(spark, tmp_path, [], "stored_again")).count() == 0
