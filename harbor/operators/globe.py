"""Density clustering (DBSCAN) of grid cells by distance on the globe.

Cells are near if their centres are at most ``eps_km`` apart along a great circle. How
many columns that reaches depends on the latitude, and columns go round: east of 180
degrees comes -180. Rows are gathered in bands as high as the reach. Each band is
divided all round into buckets at least as wide as its reach, so what is near a cell
lies in three bands and three buckets of each; near a pole a band is one bucket.

Cells of a small block are near each other by construction. A block with enough cells
is core without a neighbour looked at, and the graph whose components are the clusters
is that of blocks. Pairs are listed only of cells within reach, whose number the reach
bounds.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbor.defaults import DBSCAN_MIN_SAMPLES, EARTH_RADIUS_KM, FINE_DECIMALS, MAX_BROADCAST_ROWS
from harbor.functions.geo import cell_index, haversine_km
from harbor.operators.components import connected_components
from harbor.operators.density import NOISE, Lattice
from harbor.operators.lookup import attach
from harbor.operators.ports import CELL
from harbor.sources.scratch import materialize

TOLERANCE = 1 + 1e-12  # of the reach, for the last digits of sines


@dataclass(frozen=True)
class Globe:
    """Bands, buckets and blocks of a degree grid for a reach in kilometres."""

    decimals: int
    eps_km: float

    @property
    def per_degree(self) -> int:
        return 10**self.decimals

    @property
    def angle(self) -> float:
        """The reach as an angle at the centre of the earth, in degrees."""
        return math.degrees(self.eps_km / EARTH_RADIUS_KM)

    @property
    def band_rows(self) -> int:
        """Rows of a band: near cells lie in the same or an adjoining one."""
        return max(1, math.ceil(self.angle * self.per_degree))

    def band(self, x: Column) -> Column:
        return F.floor((x + 90 * self.per_degree) / self.band_rows)

    def buckets(self, band: Column) -> Column:
        """Buckets all round a band. At the latitude furthest from the equator of the band and of those beside it,
        the reach is asin(sin(angle / 2) / cos(latitude)) twice; beyond the pole it goes all round."""
        south = (band - 1) * (self.band_rows / self.per_degree) - 90
        north = (band + 2) * (self.band_rows / self.per_degree) - 90
        furthest = F.least(F.greatest(F.abs(south), F.abs(north)), F.lit(90.0))
        share = F.lit(math.sin(math.radians(min(180.0, self.angle)) / 2)) / F.cos(F.radians(furthest))
        reach = 2 * F.degrees(F.asin(F.least(share, F.lit(1.0))))
        return F.when(share >= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) / (reach * 1.000001)))).cast("long")

    def bucket(self, y: Column, buckets: Column) -> Column:
        """The bucket of a column; 180 degrees west is where 180 degrees east is."""
        round_ = 360 * self.per_degree
        return F.floor(F.pmod(y + 180 * self.per_degree, F.lit(round_)) * buckets / round_)

    def block(self, x: Column, y: Column) -> Column:
        """Number of the block of a cell: half the reach high, and half the reach wide where it is widest."""
        rows = max(1, math.floor(self.angle / 2 * self.per_degree) + 1)
        row = F.floor((x + 90 * self.per_degree) / rows)
        south, north = row * (rows / self.per_degree) - 90, (row + 1) * (rows / self.per_degree) - 90
        nearest = F.when((south <= 0) & (north >= 0), 0.0).otherwise(F.least(F.abs(south), F.abs(north), F.lit(90.0)))
        width = F.floor(F.lit(self.angle / 2 * self.per_degree) / F.greatest(F.cos(F.radians(nearest)), F.lit(1e-9))) + 1
        most = 360 * self.per_degree + 1
        column = F.floor((y + 180 * self.per_degree) / F.least(width, F.lit(most)))
        return row * most + column


def near_cells(left: DataFrame, right: DataFrame, globe: Globe) -> DataFrame:
    """``point`` of ``left`` and number of ``right`` as ``other``, for cells within reach of each other."""
    around = F.array(*(F.lit(step) for step in (-1, 0, 1)))
    here = left.withColumn("step", F.explode(around)).withColumn("band", globe.band(F.col("x")) + F.col("step"))
    buckets = globe.buckets(F.col("band"))
    own = globe.bucket(F.col("y"), buckets)
    sides = F.array_distinct(F.array(*(F.pmod(own + step, buckets) for step in (-1, 0, 1))))
    here = here.select("point", F.col("lat_bin").alias("lat"), F.col("lon_bin").alias("lon"), "band", F.explode(sides).alias("bucket"))
    there = right.withColumn("band", globe.band(F.col("x")))
    there = there.withColumn("bucket", globe.bucket(F.col("y"), globe.buckets(F.col("band"))))
    there = there.select(F.col("point").alias("other"), F.col("lat_bin").alias("to_lat"), F.col("lon_bin").alias("to_lon"), "band", "bucket")
    pairs = here.join(there, ["band", "bucket"])
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))
    return pairs.filter(distance <= globe.eps_km * TOLERANCE).select("point", "other")


def _core(points: DataFrame, globe: Globe, min_samples: int) -> DataFrame:
    """The cells with at least ``min_samples`` cells within reach, themselves included."""
    sizes = points.groupBy("block").agg(F.count("*").alias("cells"))
    placed = points.join(sizes, "block")
    sparse = placed.filter(F.col("cells") < min_samples).drop("cells")
    degrees = near_cells(sparse, points, globe).groupBy("point").agg(F.count("*").alias("degree"))
    enough = degrees.filter(F.col("degree") >= min_samples).select("point")
    return placed.filter(F.col("cells") >= min_samples).drop("cells").unionByName(sparse.join(enough, "point").select(sparse.columns))


def dbscan_globe(
    cells: DataFrame,
    eps_km: float,
    min_samples: int = DBSCAN_MIN_SAMPLES,
    decimals: int = FINE_DECIMALS,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Add ``role`` (core, border, noise) and ``cluster`` to each grid cell, by kilometres in place of degrees.

    Names, roles and ties are those of ``dbscan_labels``. Cells at 180 and -180 degrees are two cells of one place.
    The cells are written first, as are the core cells, the rounds of the components and the names.
    """
    globe = Globe(decimals, eps_km)
    placed = materialize(cells, "cells").withColumns({name: cell_index(F.col(cell), decimals) for name, cell in zip("xy", CELL, strict=True)})
    number = Lattice(decimals, 0.0).number(F.col("x"), F.col("y"))
    placed = placed.withColumns({"point": number, "block": globe.block(F.col("x"), F.col("y"))})
    points = placed.select("point", "x", "y", "block", *CELL)

    core = materialize(_core(points, globe, min_samples), "core") if min_samples > 1 else points
    blocks = near_cells(core, core, globe).filter(F.col("point") < F.col("other"))
    for end, name in (("point", "a"), ("other", "b")):
        blocks = blocks.join(core.select(F.col("point").alias(end), F.col("block").alias(name)), end)
    edges = blocks.filter("a <> b").select("a", "b").distinct()
    roots = connected_components(core.select(F.col("block").alias("id")).distinct(), edges)

    rooted = core.join(roots, core["block"] == roots["id"]).select("point", "root")
    names = rooted.groupBy("root").agg(F.min("point").alias("cluster"))
    labels = attach(rooted, names, ["root"], max_broadcast=max_broadcast).select("point", "cluster", F.lit("core").alias("role"))
    if min_samples > 1:
        labels = materialize(labels, "labels")
        others = points.join(labels, "point", "left_anti")
        met = near_cells(others, core, globe).join(labels.select(F.col("point").alias("other"), "cluster"), "other")
        border = met.groupBy("point").agg(F.min("cluster").alias("cluster"))
        labels = labels.unionByName(border.withColumn("role", F.lit("border")))
    labelled = placed.join(labels, "point", "left")
    return labelled.select(
        *cells.columns, F.coalesce("role", F.lit("noise")).alias("role"), F.coalesce("cluster", F.lit(NOISE)).cast("long").alias("cluster")
    )
