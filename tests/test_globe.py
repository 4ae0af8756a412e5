"""Density clustering on the globe against a brute force over all pairs."""

import math
import random

import pytest

from harbor.operators import density, globe

SCHEMA = "lat_bin double, lon_bin double, vessel_count long"


def kilometres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1.0, h)))


def number(cell):
    return (round(cell[0] * 100) + 9000) * 36001 + round(cell[1] * 100) + 18000


def brute_force(cells, eps, min_samples):
    near = {c: [d for d in cells if kilometres(c, d) <= eps * globe.TOLERANCE] for c in cells}
    core = {c for c in cells if len(near[c]) >= min_samples}
    name = {}
    for c in sorted(core, key=number):
        if c not in name:
            stack = [c]
            while stack:
                d = stack.pop()
                if d not in name:
                    name[d] = number(c)
                    stack.extend(e for e in near[d] if e in core)
    out = {c: ("core", name[c]) for c in core}
    for c in set(cells) - core:
        close = [name[d] for d in near[c] if d in core]
        out[c] = ("border", min(close)) if close else ("noise", -1)
    return out


def label(spark, cells, eps, min_samples, **options):
    table = spark.createDataFrame([(lat, lon, 5) for lat, lon in cells], SCHEMA).repartition(3)
    return {(r.lat_bin, r.lon_bin): (r.role, r.cluster) for r in globe.dbscan_globe(table, eps, min_samples, **options).collect()}


def scattered(seed, n, lat, lon, high, wide):
    """Cells around a place, columns going round."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        x = min(9000, max(-9000, round(lat * 100) + rng.randint(-high, high)))
        y = (round(lon * 100) + rng.randint(-wide, wide) + 18000) % 36000 - 18000
        out.add((x / 100, y / 100))
    return sorted(out)


CASES = [
    (1, 150, 55.0, 12.0, 60, 90, 11.1, 1), (2, 250, 55.0, 12.0, 60, 90, 5.0, 4), (3, 150, 0.0, 0.0, 60, 60, 11.1, 1),
    (4, 150, 70.0, 180.0, 60, 250, 11.1, 1), (5, 200, 70.0, -180.0, 50, 200, 8.0, 4), (6, 150, 89.9, 0.0, 30, 18000, 11.1, 1),
    (7, 200, 89.5, 90.0, 80, 18000, 20.0, 4), (8, 150, -89.8, 10.0, 40, 18000, 15.0, 3), (9, 120, -60.0, 179.9, 100, 200, 30.0, 2),
    (10, 60, 80.0, 0.0, 300, 18000, 120.0, 2), (11, 150, 55.0, 12.0, 8, 12, 1.2, 3), (12, 40, 10.0, 0.0, 8000, 18000, 2500.0, 2),
]


@pytest.mark.parametrize("seed,n,lat,lon,high,wide,eps,min_samples", CASES)
def test_against_brute_force(spark, seed, n, lat, lon, high, wide, eps, min_samples):
    cells = scattered(seed, n, lat, lon, high, wide)
    assert label(spark, cells, eps, min_samples) == brute_force(cells, eps, min_samples)


def test_both_sides_of_the_meridian(spark):
    cells = [(10.0, 180.0), (10.0, -180.0), (10.0, -179.95), (10.0, 179.95), (10.0, 179.7), (90.0, -100.0), (90.0, 80.0), (89.99, 0.0), (-90.0, 0.0)]
    found = label(spark, cells, 11.1, 1)
    assert found == brute_force(cells, 11.1, 1)
    assert len({found[cell][1] for cell in cells[:4]}) == 1 and len({found[cell][1] for cell in cells[5:8]}) == 1
    degrees = spark.createDataFrame([(lat, lon, 5) for lat, lon in cells], SCHEMA)
    assert len({r.cluster for r in density.dbscan_labels(degrees).collect()}) > len({name for _, name in found.values()})


def test_columns_count_by_latitude(spark):
    """Four columns apart: near at 70 degrees, not at the equator."""
    for lat, clusters in ((0.0, 2), (70.0, 1)):
        assert len({name for _, name in label(spark, [(lat, 10.0), (lat, 10.04)], 2.0, 1).values()}) == clusters


@pytest.mark.parametrize("eps", [1.2, 11.1, 60.0])
def test_blocks_hold_near_cells_only(spark, eps):
    rng = random.Random(4)
    cells = {(x / 100, rng.randint(-50, 50) / 100) for x in (*range(-30, 30), *range(5480, 5520), *range(8950, 9001)) for _ in range(12)}
    shape = globe.Globe(2, eps)
    table = spark.createDataFrame([(round(lat * 100), round(lon * 100)) for lat, lon in cells], "x long, y long")
    blocks = {}
    for row in table.select("x", "y", shape.block(table.x, table.y).alias("block")).collect():
        blocks.setdefault(row.block, []).append((row.x / 100, row.y / 100))
    assert all(kilometres(a, b) <= eps for inside in blocks.values() for a in inside for b in inside)
    assert len(blocks) < len(cells) or eps < 2


def test_no_cells(spark):
    assert label(spark, [(55.0, 12.0)], 5.0, 2) == {(55.0, 12.0): ("noise", -1)}
    assert globe.dbscan_globe(spark.createDataFrame([], SCHEMA), 5.0).count() == 0
