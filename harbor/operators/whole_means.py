"""k-means whose centres do not depend on how the rows are partitioned.

Places are whole numbers of a millionth of a degree and all sums are sums of whole
numbers, so the order in which parts are added up changes nothing. Centres are
rounded to the same unit. Seeds are weighted draws whose chances come from a hash of
the place itself. Several numbers of clusters are fitted in the same passes.
"""

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbor.defaults import ELBOW_CLUSTERS, KMEANS_SEED
from harbor.sources.scratch import materialize

UNITS = 1_000_000  # of a degree
PASSES, SETTLED = 20, 100  # at most so many steps; a fit is settled when no centre moves further than this
SEED_ROUNDS, DRAWN = 2, 2  # each round draws this many places for each of the clusters
MOST_PARTS = 4096  # parts of the places, each of which gives a few rows to the driver

Point = tuple[int, int]
DRAW_SCHEMA = "x long, y long, race double"
SUMS = ["k", "cluster", "n", "x_high", "x_low", "y_high", "y_low", "d_high", "d_mid", "d_low"]
LOW_PLACE, LOW_COST = 14, 20  # bits of the lower parts of sums, so that no sum of 2 ** 40 messages overflows


@dataclass(frozen=True)
class Fit:
    """Centres in whole units, their cost over all messages (in squared units) and the messages of each."""

    points: list[Point]
    cost: int
    messages: list[int]
    settled: bool

    @property
    def centers(self) -> list[tuple[float, float]]:
        """As (longitude, latitude) in degrees."""
        return [(x / UNITS, y / UNITS) for x, y in self.points]

    @property
    def wssse(self) -> float:
        return self.cost / UNITS**2


def whole_places(positions: DataFrame) -> DataFrame:
    """Distinct places in whole units with their number of messages, written once for all passes."""
    units = [F.round(F.col(name) * UNITS).cast("long").alias(short) for name, short in (("longitude", "x"), ("latitude", "y"))]
    return materialize(positions.select(*units).groupBy("x", "y").agg(F.count("*").alias("weight")), "places")


def _few_parts(places: DataFrame) -> DataFrame:
    return places.coalesce(MOST_PARTS)


# ---------------------------------------------------------------- steps on arrays


def nearest(x: np.ndarray, y: np.ndarray, points: list[Point]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and number of the nearest point; the lower number wins ties."""
    best, which = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for number, (px, py) in enumerate(points):
        d2 = (x - px) ** 2 + (y - py) ** 2
        closer = d2 < best
        best[closer], which[closer] = d2[closer], number
    return best, which


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, points: list[Point]) -> np.ndarray:
    """A row for each point: the columns of SUMS after ``cluster``."""
    d2, which = nearest(x, y, points)
    out = np.zeros((len(points), len(SUMS) - 2), np.int64)
    low, cost = (1 << LOW_PLACE) - 1, (1 << LOW_COST) - 1
    parts = [1, x >> LOW_PLACE, x & low, y >> LOW_PLACE, y & low, d2 >> 2 * LOW_COST, d2 >> LOW_COST & cost, d2 & cost]
    for column, part in enumerate(parts):
        np.add.at(out[:, column], which, weight * part)
    return out


def _totals(rows: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """Messages, sum of x, sum of y and cost of each point, without bounds."""
    return [
        (n, (xh << LOW_PLACE) + xl, (yh << LOW_PLACE) + yl, (dh << 2 * LOW_COST) + (dm << LOW_COST) + dl)
        for n, xh, xl, yh, yl, dh, dm, dl in rows
    ]


def _middle(total: int, n: int) -> int:
    """The mean, rounded half up."""
    return (2 * total + n) // (2 * n)


def moved(points: list[Point], totals: list[tuple[int, int, int, int]]) -> list[Point]:
    """The mean place of what is nearest to each point; a point without any stays."""
    return [(_middle(sx, n), _middle(sy, n)) if n else point for point, (n, sx, sy, _) in zip(points, totals, strict=True)]


def _furthest(old: list[Point], new: list[Point]) -> int:
    return max(((a - c) ** 2 + (b - d) ** 2 for (a, b), (c, d) in zip(old, new, strict=True)), default=0)


# ---------------------------------------------------------------- draws


def chance(seed: int, draw: int, x: int, y: int) -> int:
    """The 64-bit hash that Spark's ``xxhash64`` gives for the four numbers."""
    value = 42
    for number in (seed, draw, x, y):
        value = xxhash.xxh64_intdigest(struct.pack("<q", number), value)
    return value


def race(hashes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Arrival times: the first of several is each with a probability in proportion to its mass."""
    uniform = ((hashes >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    with np.errstate(divide="ignore"):
        return np.where(mass > 0, -np.log(uniform) / mass, np.inf)


def _drawn(places: DataFrame, seed: int, draw: int, number: int, chosen: list[Point]) -> list[Point]:
    """Places drawn by their messages, times the squared distance to the nearest of ``chosen`` if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, 3))
        for batch in batches:
            x, y, weight, hashes = (np.asarray(column) for column in batch.columns)
            mass = weight.astype(np.float64)
            if chosen:
                mass = mass * nearest(x, y, chosen)[0]
            times = race(hashes.view(np.uint64), mass)
            rows = np.concatenate([best, np.stack([times, x, y], axis=1)[np.isfinite(times)]])  # places are exact as doubles
            best = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))[:number]]
        columns = [pa.array(best[:, 1].astype(np.int64)), pa.array(best[:, 2].astype(np.int64)), pa.array(best[:, 0])]
        yield pa.RecordBatch.from_arrays(columns, ["x", "y", "race"])

    hashed = places.select("x", "y", "weight", F.xxhash64(*(F.lit(n).cast("long") for n in (seed, draw)), "x", "y"))
    found = hashed.mapInArrow(run, DRAW_SCHEMA).orderBy("race", "x", "y").limit(number).collect()
    return [(row.x, row.y) for row in found]


def _start(candidates: list[Point], weights: list[int], most: int, seed: int) -> list[Point]:
    """``most`` of few weighted candidates, each far from those before it with good chance."""
    x, y = (np.array([point[axis] for point in candidates], np.int64) for axis in (0, 1))
    mass = np.array(weights, np.float64)
    chosen: list[Point] = []
    for draw in range(min(most, len(candidates))):
        hashes = np.array([chance(seed, -1 - draw, *point) for point in candidates], np.uint64)
        times = race(hashes, mass * nearest(x, y, chosen)[0] if chosen else mass)
        if not np.isfinite(times).any():
            break
        first = min(range(len(candidates)), key=lambda n: (times[n], candidates[n]))
        chosen.append(candidates[first])
    return chosen


def _settle(candidates: list[Point], weights: list[int], points: list[Point]) -> list[Point]:
    """Steps over the few candidates alone."""
    x, y = (np.array([point[axis] for point in candidates], np.int64) for axis in (0, 1))
    for _ in range(PASSES):
        new = moved(points, _totals(_sums(x, y, np.array(weights, np.int64), points).tolist()))
        if new == points:
            break
        points = new
    return points


# ---------------------------------------------------------------- fits


def _pass(places: DataFrame, sets: dict[int, list[Point]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """``_totals`` over all places, for every set of points at once: one job, a few rows a part to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((len(points), len(SUMS) - 2), np.int64) for k, points in sets.items()}
        for batch in batches:
            x, y, weight = (np.asarray(column) for column in batch.columns)
            for k, points in sets.items():
                sums[k] += _sums(x, y, weight, points)
        rows = [np.column_stack([np.full(len(part), k), np.arange(len(part)), part]) for k, part in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in np.concatenate(rows).T.copy()], SUMS)

    parts = places.select("x", "y", "weight").mapInArrow(run, ", ".join(f"{name} long" for name in SUMS)).collect()
    totals = {k: [[0] * (len(SUMS) - 2) for _ in points] for k, points in sets.items()}
    for k, cluster, *values in parts:
        totals[k][cluster] = [a + b for a, b in zip(totals[k][cluster], values, strict=True)]
    return {k: _totals(rows) for k, rows in totals.items()}


def fit(places: DataFrame, clusters: tuple[int, ...], seed: int = KMEANS_SEED, passes: int = PASSES) -> dict[int, Fit]:
    """Fit every number of ``clusters`` to ``places(x, y, weight)`` of ``whole_places``.

    The same rows give the same centres on any number of partitions. Where there are fewer
    distinct places than clusters, there are as many centres as places. No places, no centres.
    """
    kept = _few_parts(places).persist()
    try:
        return _fit(kept, tuple(dict.fromkeys(clusters)), seed, passes)
    finally:
        kept.unpersist()


def _fit(places: DataFrame, clusters: tuple[int, ...], seed: int, passes: int) -> dict[int, Fit]:
    most = max(clusters)
    candidates = _drawn(places, seed, 0, 1, [])
    for draw in range(1, SEED_ROUNDS + 1):
        candidates += _drawn(places, seed, draw, DRAWN * most, candidates)
    if not candidates:
        return {k: Fit([], 0, [], True) for k in clusters}
    weights = [n for n, *_ in _pass(places, {0: candidates})[0]]
    order = _start(candidates, weights, most, seed)
    sets = {k: _settle(candidates, weights, order[:k]) for k in clusters}

    settled: set[int] = set()
    for _ in range(passes):
        going = {k: points for k, points in sets.items() if k not in settled}
        if not going:
            break
        for k, totals in _pass(places, going).items():
            new = moved(sets[k], totals)
            if _furthest(sets[k], new) <= SETTLED**2:
                settled.add(k)
            sets[k] = new
    return {
        k: Fit(sets[k], sum(cost for *_, cost in totals), [n for n, *_ in totals], k in settled)
        for k, totals in _pass(places, sets).items()
    }


def elbow_costs(places: DataFrame, clusters: tuple[int, ...] = ELBOW_CLUSTERS, seed: int = KMEANS_SEED) -> DataFrame:
    """k, messages and wssse of a fit for each number of clusters, all from the same passes."""
    fits = fit(places, clusters, seed)
    rows = [(k, sum(found.messages), found.wssse) for k, found in fits.items()]
    return places.sparkSession.createDataFrame(rows, "k int, messages long, wssse double")


def fitted_centers(places: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """Centres of all fits: k, cluster_id, longitude, latitude, messages."""
    rows = [
        (k, number, *center, messages)
        for k, found in fits.items()
        for number, (center, messages) in enumerate(zip(found.centers, found.messages, strict=True))
    ]
    return places.sparkSession.createDataFrame(rows, "k int, cluster_id int, longitude double, latitude double, messages long")
