"""Thresholds of the dwelling rules and the lookup join behind them."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harbor.operators import dwell
from harbor.operators.lookup import attach
from tests.compare import spark_rows
from tests.test_tracks import SCHEMA, haversine, messages

START = datetime(2025, 4, 20)


def vessel(mmsi, speeds, step=0.0):
    return [
        (mmsi, START + timedelta(minutes=i), 55.0 + i * step, 12.0, sog, "Cargo") for i, sog in enumerate(speeds)
    ]


def test_speed_limit_is_strict(spark):
    rows = vessel(1, [0.49, 0.5, 0.51])
    assert [r.sog for r in dwell.low_speed(spark.createDataFrame(rows, SCHEMA)).collect()] == [0.49]


def test_five_slow_messages_are_enough(spark):
    rows = vessel(1, [0.1] * 5 + [9.0] * 50) + vessel(2, [0.1] * 4 + [9.0])
    positions = spark.createDataFrame(rows, SCHEMA)
    kept = dwell.slow_positions(dwell.low_speed(positions)).collect()
    assert [(r.mmsi, r.low_speed_msgs) for r in kept] == [(1, 5)] * 5
    assert dwell.dwelling_vessels(dwell.low_speed(positions)).collect() == [(1, 5)]


def test_distance_limit_is_strict(spark):
    rows = vessel(1, [0.1] * 5, step=0.02)
    positions = spark.createDataFrame(rows, SCHEMA)
    travelled = dwell.vessel_distance(positions).first().total_distance_km
    assert travelled == pytest.approx(4 * haversine(55.0, 12.0, 55.02, 12.0))
    assert dwell.stationary_positions(positions, max_distance_km=travelled).count() == 0
    assert dwell.stationary_positions(positions, max_distance_km=travelled + 1e-9).count() == 5


def test_path_crosses_fast_messages(spark):
    rows = vessel(1, [0.1, 0.1, 9.0, 9.0, 0.1, 0.1, 0.1], step=0.001)
    rows[2] = (*rows[2][:2], 70.0, *rows[2][3:])
    slow = dwell.low_speed(spark.createDataFrame(rows, SCHEMA))
    assert dwell.vessel_distance(slow).first().total_distance_km == pytest.approx(6 * haversine(55, 12, 55.001, 12))


def test_movers(spark):
    rows = vessel(1, [0.5] * 5 + [0.1]) + vessel(2, [0.5] * 6)
    kept = dwell.mover_exclusion(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.mmsi, r.fast_msgs) for r in kept] == [(1, 5)] * 6


@pytest.mark.parametrize("max_broadcast", [1, 2, 3, 10, 1000])
def test_attach_equals_join(spark, max_broadcast):
    rows = spark.createDataFrame(messages(3), SCHEMA).repartition(4)
    table = rows.groupBy("mmsi").agg(F.count("*").alias("n"), F.max("latitude").alias("north"))
    keep = F.col("n") >= 4
    expected = spark_rows(rows.join(table.filter(keep), "mmsi"))
    assert spark_rows(attach(rows, table, ["mmsi"], keep, max_broadcast)) == expected


def test_attach_by_bytes(spark):
    rows = spark.createDataFrame(messages(3), SCHEMA).repartition(4)
    table = rows.groupBy("mmsi").agg(F.count("*").alias("n"))
    plain = attach(rows, table, ["mmsi"], max_bytes=1)
    assert "rightHint" not in plain._jdf.queryExecution().analyzed().toString()
    assert spark_rows(plain) == spark_rows(attach(rows, table, ["mmsi"]))


def test_attach_to_nothing(spark):
    rows = spark.createDataFrame([], SCHEMA)
    table = rows.groupBy("mmsi").agg(F.count("*").alias("n"))
    assert attach(rows, table, ["mmsi"]).count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 7])
def test_same_result_on_any_partitioning(spark, partitions):
    rows = messages(9)
    one = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    many = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    limits = {"min_messages": 3, "max_distance_km": 40.0}
    expected = dwell.stationary_positions(one, **limits).drop("total_distance_km")
    found = dwell.stationary_positions(many, **limits, max_piece_rows=3, max_broadcast=2)
    assert spark_rows(found.drop("total_distance_km")) == spark_rows(expected)
    assert found.count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_messages_are_looked_up_not_shuffled(spark):
    positions = spark.createDataFrame(messages(2), SCHEMA)
    plan = plan_of(dwell.stationary_positions(positions))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_many_vessels_are_not_broadcast(spark):
    positions = spark.createDataFrame(messages(2), SCHEMA)
    few, many = (dwell.stationary_positions(positions, max_broadcast=n) for n in (1000, 1))
    assert "rightHint=(strategy=broadcast)" in few._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint" not in many._jdf.queryExecution().optimizedPlan().toString()
