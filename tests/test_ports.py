"""Grid cells, bubbles and k-means on hand-made rows."""

import json
from datetime import datetime

import pytest

from harbor.operators import centers, ports, report
from harbor.plans import detection
from harbor.sources.events import positions_from_events
from harbor.sources.reports import read_positions, write_map_features, write_positions
from harbor.operators.clean import clean_typed

SCHEMA = "mmsi long, ts timestamp_ntz, latitude double, longitude double, sog double, ship_type string"
CELLS = "lat_bin double, lon_bin double, vessel_count long"
NOON = datetime(2025, 4, 20, 12)


def at(*places):
    return [(mmsi, NOON, lat, lon, 0.1, "Cargo") for mmsi, lat, lon in places]


def test_half_up(spark):
    binned = ports.fine_bins(spark.createDataFrame(at((1, 55.675, 12.005), (2, -0.004, 0.0)), SCHEMA)).collect()
    assert [(r.lat_bin, r.lon_bin) for r in binned] == [(55.68, 12.01), (0.0, 0.0)]


def test_vessels_are_counted_once_per_cell(spark):
    rows = at(*[(m, 55.6, 12.0) for m in (1, 1, 2, 3, 4, 5)], *[(m, 57.0, 10.0) for m in (1, 2, 3, 4, 4)])
    assert ports.port_candidates(spark.createDataFrame(rows, SCHEMA)).collect() == [(55.6, 12.0, 5)]


def test_double_count_and_true_count(spark):
    positions = spark.createDataFrame(at((1, 55.61, 12.0), (1, 55.62, 12.0)), SCHEMA)
    candidates = ports.port_candidates(positions, min_vessels=1)
    assert ports.coarse_ports(candidates).collect() == [(55.6, 12.0, 2)]
    labelled = ports.coarse_bins(candidates)
    port = ["lat_bin_ports", "lon_bin_ports"]
    found = ports.distinct_port_vessels(ports.fine_bins(positions), labelled, port).first()
    assert (found.vessel_count, found.distinct_vessels) == (2, 1)


def test_bubbles(spark, tmp_path):
    cells = spark.createDataFrame([(55.0, 12.0, 7), (57.0, 10.0, 131)], CELLS)
    features = report.map_features(cells)
    assert features.collect() == [(55.0, 12.0, 7, "Vessels: 7"), (57.0, 10.0, 20, "Vessels: 131")]
    assert report.map_center(cells).collect() == [(56.0, 11.0)]
    feature = json.loads(report.geojson_features(features).first().feature)
    assert feature["geometry"] == {"type": "Point", "coordinates": [12.0, 55.0]}
    path = str(tmp_path / "map")
    write_map_features(features, path)
    assert sorted(spark.read.json(path).select("popup").collect()) == [("Vessels: 131",), ("Vessels: 7",)]


def test_size_range(spark):
    cells = spark.createDataFrame([(55.0 + i, 12.0, n) for i, n in enumerate((9, 34, 56, 40, 38, 50, 7))], CELLS)
    assert report.port_size_range(cells, "grid").collect() == [("grid", "all", 7, 7, 56), ("grid", "top 5", 5, 34, 56)]


def test_nearest_center(spark):
    positions = spark.createDataFrame(at((1, 55.0, 12.1), (2, 55.0, 12.5), (3, 55.0, 13.1)), SCHEMA)
    assigned = centers.assign_to_centers(positions, [(12.0, 55.0), (13.0, 55.0)])
    assert [r.prediction for r in assigned.orderBy("mmsi").collect()] == [0, 0, 1]


@pytest.fixture(scope="module")
def positions(spark):
    return clean_typed(positions_from_events(spark, "/root/testdata/sf0.01"))


def test_grid_report(positions):
    found = detection.grid_report(positions)
    assert found.stationary.count() == 3718
    assert found.candidates.count() == 23
    assert sorted(r.vessel_count for r in found.clusters.collect()) == [29, 46, 66, 71]
    assert found.coarse.count() == 6


def test_kmeans_reports(positions):
    stationary = detection.grid_report(positions).stationary
    made = detection.kmeans_reports(stationary, (3, 7, 15, 20), min_vessels=1)
    for k, found in made.items():
        assert found.centers.count() == k
        assert found.assigned.count() == 3718
        assert 1 <= found.counts.count() <= k
        popups = [r.popup for r in found.features.collect()]
        assert len(popups) == found.counts.count() and all(", Cluster: " in p and "." not in p for p in popups)


def test_weighted_places_cost_the_same(positions):
    stationary = detection.grid_report(positions).stationary
    model = centers.kmeans_fit(centers.weighted_places(stationary), 3, weight="weight")
    given = [tuple(map(float, c)) for c in model.clusterCenters()]
    cost = sum(r.wssse for r in centers.wssse_for_centers(stationary, given).collect())
    assert model.summary.trainingCost == pytest.approx(cost, rel=1e-6)
    by_model = centers.kmeans_assign(model, stationary).select("mmsi", "ts", "prediction")
    by_place = centers.assign_to_centers(stationary, given).select("mmsi", "ts", "prediction")
    assert by_model.exceptAll(by_place).count() == 0


def test_elbow_falls(positions):
    stationary = detection.grid_report(positions).stationary
    costs = centers.elbow_costs(centers.weighted_places(stationary), weight="weight").orderBy("k").collect()
    assert [r.k for r in costs] == list(range(2, 10))
    assert all(b.wssse <= a.wssse * 1.2 for a, b in zip(costs, costs[1:]))
    assert costs[-1].wssse < costs[0].wssse


def test_elbow_reads_the_places_once(spark, positions):
    places = centers.weighted_places(detection.grid_report(positions).stationary)
    with centers.held(places) as kept:
        assert kept.storageLevel.useMemory
        centers.kmeans_fit(kept, 3, weight="weight")
    assert not places.storageLevel.useMemory


def test_rounded_places_hold_all_messages(positions):
    stationary = detection.grid_report(positions).stationary
    exact, coarse = centers.weighted_places(stationary), centers.weighted_places(stationary, decimals=3)
    assert coarse.count() < exact.count()
    assert coarse.agg({"weight": "sum"}).first() == exact.agg({"weight": "sum"}).first()


def test_positions_by_day(spark, positions, tmp_path):
    path = str(tmp_path / "positions")
    write_positions(positions, path)
    stored = read_positions(spark, path)
    assert sorted(stored.drop("day").collect(), key=repr) == sorted(positions.collect(), key=repr)
    day = stored.selectExpr("min(day)").first()[0]
    one = stored.filter(stored.day == day)
    assert one.count() == positions.filter(f"to_date(ts) = DATE'{day}'").count() > 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
