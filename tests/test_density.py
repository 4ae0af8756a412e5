"""Density clustering against a brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from harbor.operators import density
from harbor.operators.components import connected_components

SCHEMA = "lat_bin double, lon_bin double, vessel_count long"


def brute_force(points, reach2, min_samples):
    """{(x, y): (role, smallest core point of the cluster)}"""
    near = {p: [q for q in points if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= reach2] for p in points}
    core = {p for p in points if len(near[p]) >= min_samples}
    name = {}
    for p in sorted(core):
        if p not in name:
            stack = [p]
            while stack:
                q = stack.pop()
                if q not in name:
                    name[q] = p
                    stack.extend(r for r in near[q] if r in core)
    labels = {p: ("core", name[p]) for p in core}
    for p in points:
        if p not in core:
            close = [name[q] for q in near[p] if q in core]
            labels[p] = ("border", min(close)) if close else ("noise", None)
    return labels


def number(point):
    return (point[0] + 9000) * 36001 + point[1] + 18000


def label(spark, points, eps, min_samples, **options):
    rows = [(x / 100, y / 100, 5) for x, y in points]
    cells = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labelled = density.dbscan_labels(cells, eps, min_samples, **options)
    return {
        (round(r.lat_bin * 100), round(r.lon_bin * 100)): (r.role, None if r.cluster == -1 else r.cluster)
        for r in labelled.collect()
    }


def scattered(seed, n, side):
    rng = random.Random(seed)
    return sorted({(5500 + rng.randint(-side, side), 1000 + rng.randint(-side, side)) for _ in range(n)})


CASES = [
    (1, 150, 60, 0.1, 1),
    (2, 400, 100, 0.1, 1),
    (3, 300, 80, 0.1, 4),
    (4, 300, 60, 0.1, 6),
    (5, 200, 12, 0.01, 3),
    (6, 250, 40, 0.05, 5),
    (7, 120, 200, 0.3, 2),
    (8, 300, 30, 0.02, 1),
    (9, 60, 300, 0.37, 1),
]


@pytest.mark.parametrize("seed,n,side,eps,min_samples", CASES)
def test_against_brute_force(spark, seed, n, side, eps, min_samples):
    points = scattered(seed, n, side)
    reach2 = round((eps * 100) ** 2)
    expected = {
        p: (role, None if name is None else number(name))
        for p, (role, name) in brute_force(points, reach2, min_samples).items()
    }
    assert label(spark, points, eps, min_samples) == expected


def test_many_clusters_without_broadcast(spark):
    points = scattered(10, 200, 90)
    assert label(spark, points, 0.1, 1, max_broadcast=3) == label(spark, points, 0.1, 1)


def test_negative_coordinates(spark):
    points = [(-5, -3), (4, 3), (-9000, -18000), (9000, 18000), (-1, 2)]
    expected = {p: ("core", number(name)) for p, (_, name) in brute_force(points, 100, 1).items()}
    assert label(spark, points, 0.1, 1) == expected


def test_exactly_eps_apart_is_near(spark):
    apart = {(5500, 1000), (5510, 1000), (5500, 1011), (5508, 1017)}
    clusters = label(spark, sorted(apart), 0.1, 1)
    assert clusters[(5500, 1000)] == clusters[(5510, 1000)]
    assert clusters[(5500, 1011)] == clusters[(5508, 1017)]
    assert clusters[(5500, 1000)] != clusters[(5500, 1011)]


@pytest.mark.parametrize("order", ["rising", "mixed"])
def test_long_chain_settles(spark, order):
    place = {"rising": lambda c: F.col(c), "mixed": lambda c: (F.col(c) * 7919) % 100_003}[order]
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.select(place("a").alias("a"), place("b").alias("b"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"))
    nodes = ends.unionByName(spark.createDataFrame([(200_000,)], "id long")).distinct()
    roots = connected_components(nodes, edges, max_rounds=25).collect()
    chain = {r.root for r in roots if r.id < 200_000}
    assert len(roots) == 3002 and len(chain) == 1 and chain <= {r.id for r in roots}
    assert [r.root for r in roots if r.id == 200_000] == [200_000]


def test_star_settles(spark):
    edges = spark.range(1, 500).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    nodes = spark.range(1, 500).unionByName(spark.createDataFrame([(1000,)], "id long"))
    assert len({r.root for r in connected_components(nodes, edges, max_rounds=12).collect()}) == 1


def test_too_few_rounds_is_an_error(spark):
    edges = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        connected_components(spark.range(51), edges, max_rounds=1)


def test_port_totals(spark):
    rows = [(55.0, 12.0, 5), (55.02, 12.04, 7), (57.0, 10.0, 40)]
    cells = spark.createDataFrame(rows, SCHEMA)
    ports = density.dbscan_ports(density.dbscan_labels(cells))
    found = [(round(r.lat_bin, 6), round(r.lon_bin, 6), r.vessel_count) for r in density.top_dbscan_ports(ports).collect()]
    assert found == [(57.0, 10.0, 40), (55.01, 12.02, 12)]


@pytest.mark.parametrize("eps", [0.02, 0.1, 0.3])
@pytest.mark.parametrize("min_samples", [2, 5, 40, 300])
def test_core_cells_count_neighbours(spark, eps, min_samples):
    rng = random.Random(min_samples)
    cells = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(300)} | {(x, y) for x in range(12) for y in range(12)}
    lattice = density.Lattice(2, eps)
    place = spark.createDataFrame([(100 * x + y, x, y) for x, y in cells], "point long, x long, y long")
    found = {r.point for r in density.core_cells(place, lattice, min_samples).collect()}
    near = {c: sum((c[0] - d[0]) ** 2 + (c[1] - d[1]) ** 2 <= lattice.reach2 for d in cells) for c in cells}
    assert found == {100 * x + y for (x, y), n in near.items() if n >= min_samples}


def test_dense_lattice_lists_no_pairs(spark):
    """60 by 60 cells at eps 0.3 have six million near pairs; all are core without one."""
    place = spark.range(3600).selectExpr("id AS point", "id DIV 60 AS x", "id % 60 AS y")
    lattice = density.Lattice(2, 0.3)
    asked = density._blocks(place, lattice).groupBy("id").count().filter("count < 5").count()
    assert asked == 0 and density.core_cells(place, lattice, 5).count() == 3600
    plan = density.core_cells(place, lattice, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "bx" not in plan
