"""k-means in whole numbers: the same centres on any partitioning, equal to a replay over plain lists."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from harbor.operators import whole_means
from harbor.operators.centers import costs_for_centers

SCHEMA = "longitude double, latitude double"
CLUSTERS = (7, 15, 20)


def positions(seed, n=900):
    """Crowded ports, a third of the messages at one place, strays, and the far corners."""
    rng = random.Random(seed)
    ports = [(rng.uniform(5, 15), rng.uniform(50, 60)) for _ in range(12)]
    rows = [(round(rng.choice(ports)[0] + rng.gauss(0, 0.01), 4), round(rng.choice(ports)[1] + rng.gauss(0, 0.01), 4)) for _ in range(n)]
    return rows + [(10.5, 55.5)] * (n // 2) + [(-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (12.3456782, 56.7654328)]


def whole(rows):
    counts = {}
    for lon, lat in rows:
        point = round(lon * 10**6), round(lat * 10**6)
        counts[point] = counts.get(point, 0) + 1
    return counts


def d2(a, b):
    return (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2


def replay(rows, clusters, seed):
    """Seeds, steps and costs place by place, in plain integers."""
    places, most = whole(rows), max(clusters)

    def arrivals(points, masses, draw):
        out = []
        for point, mass in zip(points, masses, strict=True):
            uniform = ((whole_means.chance(seed, draw, *point) >> 11) + 0.5) / 2**53
            if mass:
                out.append((-math.log(uniform) / mass, point))
        return [point for _, point in sorted(out)]

    def step(weighted, points):
        members = [[] for _ in points]
        for place, n in weighted.items():
            near = min(range(len(points)), key=lambda c: (d2(place, points[c]), c))
            members[near].append((place, n))
        new = []
        for point, inside in zip(points, members, strict=True):
            total = sum(n for _, n in inside)
            new.append(tuple((2 * sum(p[axis] * n for p, n in inside) + total) // (2 * total) for axis in (0, 1)) if inside else point)
        return new, sum(d2(place, points[c]) * n for c, inside in enumerate(members) for place, n in inside), members

    chosen = arrivals(places, places.values(), 0)[:1]
    for draw in range(1, whole_means.SEED_ROUNDS + 1):
        masses = [n * float(min(d2(place, point) for point in chosen)) for place, n in places.items()]
        chosen = chosen + arrivals(places, masses, draw)[: whole_means.DRAWN * most]
    weights = [sum(n for _, n in inside) for inside in step(places, chosen)[2]]
    weighted = dict(zip(chosen, weights, strict=True))
    order = []
    for draw in range(min(most, len(chosen))):
        masses = [n * float(min(d2(place, point) for point in order)) if order else float(n) for place, n in weighted.items()]
        order += arrivals(weighted, masses, -1 - draw)[:1]
    out = {}
    for k in clusters:
        points = order[:k]
        for _ in range(whole_means.PASSES):
            points = step(weighted, points)[0]
        for _ in range(whole_means.PASSES):
            new = step(places, points)[0]
            near = max(d2(a, b) for a, b in zip(points, new, strict=True)) <= whole_means.SETTLED**2
            points = new
            if near:
                break
        out[k] = points, step(places, points)[1]
    return out


@pytest.mark.parametrize("seed", [1, 5])
def test_replay_on_any_partitioning(spark, seed):
    rows = positions(seed)
    expected = replay(rows, CLUSTERS, seed)
    for partitions in (1, 4, 32):
        places = whole_means.whole_places(spark.createDataFrame(rows, SCHEMA)).repartition(partitions, F.rand(partitions))
        fits = whole_means.fit(places, CLUSTERS, seed)
        assert {k: (found.points, found.cost) for k, found in fits.items()} == expected


def test_costs_and_shared_passes(spark):
    rows = positions(3)
    table = spark.createDataFrame(rows, SCHEMA)
    places = whole_means.whole_places(table)
    together = whole_means.fit(places, (2, 3, 9))
    costs = {row.k: row for row in costs_for_centers(table, {k: found.centers for k, found in together.items()}).collect()}
    for k, found in together.items():
        assert found.wssse == pytest.approx(costs[k].wssse, rel=1e-6) and sum(found.messages) == len(rows)
    listed = {row.k: (row.messages, row.wssse) for row in whole_means.elbow_costs(places, (2, 3, 9)).collect()}
    assert listed == {k: (len(rows), found.wssse) for k, found in together.items()}


def test_fits_are_as_good_as_the_engine(spark):
    """Over several seeds the cost is on average no more than a tenth above that of MLlib."""
    from harbor.operators import centers

    table = spark.createDataFrame(positions(11), SCHEMA)
    places, vectors = whole_means.whole_places(table), centers.weighted_places(table)
    ours = sum(whole_means.fit(places, (7,), seed)[7].wssse for seed in range(4))
    theirs = sum(float(centers.kmeans_fit(vectors, 7, seed, "weight").summary.trainingCost) for seed in range(4))
    assert ours <= 1.1 * theirs


def test_few_places_and_none(spark):
    rows = [(10.0, 55.0)] * 5 + [(10.0, 55.1)]
    fits = whole_means.fit(whole_means.whole_places(spark.createDataFrame(rows, SCHEMA)), (1, 2, 3))
    assert sorted(fits[3].centers) == sorted(fits[2].centers) == [(10.0, 55.0), (10.0, 55.1)] and fits[2].cost == 0
    assert fits[1].centers == [(10.0, 55.016667)] and fits[1].messages == [6]
    empty = whole_means.whole_places(spark.createDataFrame([], SCHEMA))
    assert whole_means.fit(empty, (2,))[2].points == [] and whole_means.elbow_costs(empty, (2,)).first().messages == 0


def test_sums_beyond_64_bits():
    points = [(0, 0)]
    x = y = whole_means.np.array([180_000_000], whole_means.np.int64)
    rows = whole_means._sums(x, y, whole_means.np.array([2**40], whole_means.np.int64), points).tolist()
    assert whole_means._totals(rows) == [(2**40, 2**40 * 180_000_000, 2**40 * 180_000_000, 2**40 * 2 * 180_000_000**2)]


def test_chance_is_the_hash_of_spark(spark):
    rows = [(1, 0, 12, -5), (7, -3, -180_000_000, 90_000_000)]
    table = spark.createDataFrame(rows, "a long, b long, c long, d long").select(F.xxhash64("a", "b", "c", "d").alias("h"))
    assert [row.h % 2**64 for row in table.collect()] == [whole_means.chance(*row) for row in rows]


def test_dates_do_not_matter(spark):
    rows = [(*row, datetime(2025, 4, 20)) for row in positions(2, 60)]
    table = spark.createDataFrame(rows, SCHEMA + ", ts timestamp_ntz")
    assert whole_means.whole_places(table).columns == ["x", "y", "weight"]
