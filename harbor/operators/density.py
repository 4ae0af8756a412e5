"""Density clustering (DBSCAN) of grid cells.

Cells are points of an integer lattice, so "at most eps apart" is an exact test on
whole numbers and the number of neighbours of a cell is bounded by eps, not by the
data. Clusters are found in three steps:

1. A cell is a core cell when enough cells, itself included, lie within eps. With
   ``min_samples=1`` every cell is, and so is every cell of a block (below) that holds
   enough cells. For the others the cells within reach are counted row by row from
   running counts, without listing pairs.
2. Core cells are gathered in square blocks small enough that all cells of a block
   are within eps of each other. Two blocks touch when some core cell of one is
   within eps of one of the other; for that only the outermost cells of each row
   (or column) of a block need comparing. The connected components of the block
   graph are the clusters.
3. Other cells within eps of a core cell are border cells; the rest is noise.
"""

from dataclasses import dataclass
from decimal import Decimal
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbor.defaults import DBSCAN_EPS, DBSCAN_MIN_SAMPLES, FINE_DECIMALS, MAX_BROADCAST_ROWS
from harbor.functions.geo import cell_index
from harbor.operators.components import connected_components
from harbor.operators.lookup import attach
from harbor.operators.ports import CELL, top_ports
from harbor.sources.scratch import materialize

NOISE = -1


@dataclass(frozen=True)
class Lattice:
    """Whole-number geometry of a degree grid and a reach on it."""

    decimals: int
    eps: float

    @property
    def reach2(self) -> int:
        """Largest squared distance, in cells, that counts as near."""
        return int((Decimal(str(self.eps)) * 10**self.decimals) ** 2)

    @property
    def bucket(self) -> int:
        """Side of a square bucket; near cells are in the same or an adjoining one."""
        return max(1, isqrt(self.reach2))

    @property
    def block(self) -> int:
        """Side of the largest square whose cells are all near each other."""
        return isqrt(self.reach2 // 2) + 1

    @property
    def block_reach(self) -> int:
        """How many blocks away the nearest cells of two blocks can still be near."""
        return (self.bucket - 1) // self.block + 1

    def number(self, x: Column, y: Column) -> Column:
        """Number of a cell, growing with (x, y); blocks are numbered alike."""
        per_degree = 10**self.decimals
        return (x + 90 * per_degree) * (360 * per_degree + 1) + (y + 180 * per_degree)

    def near(self, dx: Column, dy: Column) -> Column:
        return dx * dx + dy * dy <= self.reach2


def _points(cells: DataFrame, lattice: Lattice) -> DataFrame:
    """Cells with lattice position and number."""
    placed = cells.withColumns(
        {name: cell_index(F.col(cell), lattice.decimals) for name, cell in zip("xy", CELL)}
    )
    return placed.withColumn("point", lattice.number(F.col("x"), F.col("y")))


def _near_pairs(left: DataFrame, right: DataFrame, lattice: Lattice) -> DataFrame:
    """Point of ``left``, and number of ``right`` as ``other``, for cells at most eps apart."""

    def bucket(name: str) -> Column:
        return F.floor(F.col(name) / lattice.bucket)

    around = F.array([F.lit(step) for step in (-1, 0, 1)])
    here = left.select("point", "x", "y", F.explode(around).alias("step_x")).withColumn("step_y", F.explode(around))
    here = here.withColumns({"bx": bucket("x") + F.col("step_x"), "by": bucket("y") + F.col("step_y")})
    there = right.select(
        F.col("point").alias("other"),
        F.col("x").alias("other_x"),
        F.col("y").alias("other_y"),
        bucket("x").alias("bx"),
        bucket("y").alias("by"),
    )
    pairs = here.join(there, ["bx", "by"])
    return pairs.filter(lattice.near(F.col("other_x") - F.col("x"), F.col("other_y") - F.col("y")))


def _blocks(core: DataFrame, lattice: Lattice) -> DataFrame:
    """Cells with the position and number ``id`` of their block."""
    placed = core.withColumns({f"block_{name}": F.floor(F.col(name) / lattice.block) for name in "xy"})
    return placed.withColumn("id", lattice.number(F.col("block_x"), F.col("block_y")))


def core_cells(place: DataFrame, lattice: Lattice, min_samples: int) -> DataFrame:
    """The cells of ``place(point, x, y)`` with at least ``min_samples`` cells within reach.

    Rows made: two for each lattice row within reach of each cell in a sparse block.
    """
    placed = _blocks(place, lattice)
    sizes = placed.groupBy("id").agg(F.count("*").alias("cells"))
    placed = placed.join(sizes, "id")
    dense = placed.filter(F.col("cells") >= min_samples).select("point", "x", "y")
    sparse = placed.filter(F.col("cells") < min_samples).select("point", "x", "y")

    reach = lattice.bucket
    half_widths = F.array(*(F.lit(isqrt(lattice.reach2 - step * step)) for step in range(-reach, reach + 1)))
    rows = sparse.select("point", "x", "y", F.posexplode(half_widths).alias("step", "half"))
    ends = F.array(
        F.struct((F.col("y") + F.col("half")).alias("upto"), F.lit(1).alias("sign")),
        F.struct((F.col("y") - F.col("half") - 1).alias("upto"), F.lit(-1).alias("sign")),
    )
    asked = rows.select("point", (F.col("x") + F.col("step") - reach).alias("row"), F.inline(ends))
    there = place.select(
        F.lit(None).cast("long").alias("point"), F.col("x").alias("row"), F.col("y").alias("upto"), F.lit(0).alias("sign")
    )
    along = Window.partitionBy("row").orderBy("upto").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = there.unionByName(asked).withColumn("before", F.count_if(F.col("sign") == 0).over(along))
    degrees = counted.filter("sign <> 0").groupBy("point").agg(F.sum(F.col("before") * F.col("sign")).alias("degree"))
    enough = degrees.filter(F.col("degree") >= min_samples).select("point")
    return dense.unionByName(sparse.join(enough, "point"))


def _touching_blocks(core: DataFrame, lattice: Lattice) -> DataFrame:
    """Pairs of blocks that hold core cells at most eps apart.

    Of two blocks, one follows the other northward, or they are level and one
    follows eastward. Either way, on a pair of lines that run in that direction the
    last cell of the first block and the first cell of the second are the closest.
    """

    def lines(line: str, along: str, sideways: int) -> DataFrame:
        return core.groupBy(
            F.lit(sideways).alias("sideways"),
            F.col(f"block_{line}").alias("block_line"),
            F.col(f"block_{along}").alias("block_along"),
            "id",
            F.col(line).alias("line"),
        ).agg(F.min(along).alias("first"), F.max(along).alias("last"))

    reach = lattice.block_reach
    ends = lines("y", "x", reach).unionByName(lines("x", "y", 0))
    ahead = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    ahead = ahead.withColumn("aside", F.explode(F.sequence(-F.col("sideways"), "sideways")))
    ahead = ahead.select(
        F.col("id").alias("a"),
        F.col("line").alias("from_line"),
        "last",
        "sideways",
        (F.col("block_line") + F.col("aside")).alias("block_line"),
        (F.col("block_along") + F.col("step")).alias("block_along"),
    )
    pairs = ahead.join(ends.drop("last"), ["sideways", "block_line", "block_along"])
    near = lattice.near(F.col("line") - F.col("from_line"), F.col("first") - F.col("last"))
    return pairs.filter(near).select("a", F.col("id").alias("b"))


def dbscan_labels(
    cells: DataFrame,
    eps: float = DBSCAN_EPS,
    min_samples: int = DBSCAN_MIN_SAMPLES,
    decimals: int = FINE_DECIMALS,
    max_rounds: int = 100,
    max_broadcast: int = MAX_BROADCAST_ROWS,
    written: bool = False,
) -> DataFrame:
    """Add ``role`` (core, border, noise) and ``cluster`` to each grid cell.

    ``cells`` has distinct cells of a grid with ``decimals`` places and any further
    columns. A cluster is named by the number of its smallest core cell, noise is
    -1. A border cell near several clusters takes the smallest name. The cells are
    written first, unless ``written`` says that they are a table at rest; so are the
    core cells, the rounds of the components and the names of the clusters.
    """
    lattice = Lattice(decimals, eps)
    points = _points(cells if written else materialize(cells, "cells"), lattice)
    place = points.select("point", "x", "y")
    core = materialize(core_cells(place, lattice, min_samples), "core") if min_samples > 1 else place
    core = _blocks(core, lattice)
    roots = connected_components(core.select("id").distinct(), _touching_blocks(core, lattice), max_rounds)

    rooted = core.join(roots, "id").select("point", "root")
    names = rooted.groupBy("root").agg(F.min("point").alias("cluster"))
    labels = attach(rooted, names, ["root"], max_broadcast=max_broadcast)
    labels = labels.select("point", "cluster", F.lit("core").alias("role"))

    if min_samples > 1:
        labels = materialize(labels, "labels")
        sparse = place.join(labels, "point", "left_anti")
        border = (
            _near_pairs(sparse, place.join(labels.select("point"), "point"), lattice)
            .join(labels.select(F.col("point").alias("other"), "cluster"), "other")
            .groupBy("point")
            .agg(F.min("cluster").alias("cluster"))
        )
        labels = labels.unionByName(border.withColumn("role", F.lit("border")))

    labelled = points.join(labels, "point", "left")
    return labelled.select(
        *cells.columns,
        F.coalesce("role", F.lit("noise")).alias("role"),
        F.coalesce("cluster", F.lit(NOISE)).cast("long").alias("cluster"),
    )


def dbscan_ports(labelled: DataFrame) -> DataFrame:
    """Per cluster: unweighted mean place of its cells and sum of their vessel counts.

    Noise cells, which exist only with ``min_samples`` above 1, form the row of cluster -1.
    """
    return labelled.groupBy("cluster").agg(
        F.avg("lat_bin").alias("lat_bin"),
        F.avg("lon_bin").alias("lon_bin"),
        F.sum("vessel_count").alias("vessel_count"),
    )


def top_dbscan_ports(ports: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` clusters with most vessels."""
    return top_ports(ports, n, "cluster")
