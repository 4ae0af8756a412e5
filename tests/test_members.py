"""Vessels of cells as bitmaps against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from harbor.operators import members, ports
from harbor.sources.scratch import materialize

SCHEMA = "mmsi long, lat_bin double, lon_bin double"


def rows(seed, vessels, cells, n):
    """A third of the rows in one cell, some vessels in many cells, rows that repeat."""
    rng = random.Random(seed)
    places = [(round(55 + rng.randint(0, 30) / 100, 2), round(10 + rng.randint(0, 30) / 100, 2)) for _ in range(cells)]
    made = [(rng.randint(1, vessels), *(places[0] if rng.random() < 1 / 3 else rng.choice(places))) for _ in range(n)]
    return made + made[: n // 4]


def vessels_of(made):
    found = {}
    for vessel, *cell in made:
        found.setdefault(tuple(cell), set()).add(vessel)
    return found


@pytest.mark.parametrize("vessels,partitions", [(40, 1), (500, 7), (90_000, 5)])
def test_counts_roll_up(spark, vessels, partitions):
    made = rows(vessels, vessels, 60, 4000 if vessels < 1000 else 100_000)
    table = members.cell_vessels(spark.createDataFrame(made, SCHEMA).repartition(partitions))
    expected = vessels_of(made)
    counts = {(r.lat_bin, r.lon_bin): r.vessel_count for r in members.vessel_counts(table, ports.CELL).collect()}
    assert counts == {cell: len(inside) for cell, inside in expected.items()}
    candidates = members.candidate_cells(table, 20)
    assert candidates.count() == sum(len(inside) >= 20 for inside in expected.values())

    labelled = materialize(ports.coarse_bins(candidates), "labelled")
    port = ["lat_bin_ports", "lon_bin_ports"]
    found = {(r.lat_bin_ports, r.lon_bin_ports): (r.vessel_count, r.distinct_vessels) for r in members.port_vessels(table, labelled, port).collect()}
    wanted = {}
    for row in labelled.collect():
        total, inside = wanted.get((row.lat_bin_ports, row.lon_bin_ports), (0, set()))
        wanted[row.lat_bin_ports, row.lon_bin_ports] = total + row.vessel_count, inside | expected[row.lat_bin, row.lon_bin]
    assert found == {name: (total, len(inside)) for name, (total, inside) in wanted.items()}
    by_scan = ports.distinct_port_vessels(spark.createDataFrame(made, SCHEMA), labelled, port)
    assert sorted(map(tuple, by_scan.collect())) == sorted((*name, *values) for name, values in found.items())


def test_unions_of_unions(spark):
    """Cells to coarse cells to everything equals cells to everything."""
    made = rows(3, 300, 50, 3000)
    table = members.cell_vessels(spark.createDataFrame(made, SCHEMA).repartition(4))
    coarse = members.united(ports.coarse_bins(table), ["lat_bin_ports", "lon_bin_ports"])
    whole = F.lit("all").alias("name")
    by_step = members.vessel_counts(members.united(coarse.withColumn("name", whole), ["name"]), ["name"]).first()
    at_once = members.vessel_counts(members.united(table.withColumn("name", whole), ["name"]), ["name"]).first()
    assert by_step.vessel_count == at_once.vessel_count == len({vessel for vessel, *_ in made})


def test_positions_are_not_read_again(spark):
    table = members.cell_vessels(spark.createDataFrame(rows(1, 50, 10, 300), SCHEMA))
    plan = members.port_vessels(table, ports.coarse_bins(members.candidate_cells(table, 2)), ["lat_bin_ports", "lon_bin_ports"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "mmsi" not in text and "LogicalRDD" not in text


def test_numbers_are_distinct(spark):
    table = spark.range(10_000).select((F.col("id") * 7919 % 5000).alias("mmsi")).repartition(6)
    numbers = [r.number for r in members.vessel_numbers(table).collect()]
    assert len(numbers) == len(set(numbers)) == 5000 and min(numbers) >= 1


def test_no_positions(spark):
    table = members.cell_vessels(spark.createDataFrame([], SCHEMA))
    assert table.count() == members.candidate_cells(table, 1).count() == 0
