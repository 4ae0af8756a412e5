"""Ports as grid cells with many vessels.

``count_distinct`` is planned as a pre-aggregated distinct on (cell, vessel) and a
pre-aggregated count on the cell, so a crowded cell is no hot key.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbor.defaults import COARSE_DECIMALS, FINE_DECIMALS, MAX_BROADCAST_ROWS, MIN_PORT_VESSELS
from harbor.functions.geo import cell_degrees
from harbor.operators.lookup import attach

CELL = ["lat_bin", "lon_bin"]


def fine_bins(positions: DataFrame, decimals: int = FINE_DECIMALS) -> DataFrame:
    """Add the grid cell of each message."""
    return positions.withColumns(
        {
            "lat_bin": cell_degrees(F.col("latitude"), decimals),
            "lon_bin": cell_degrees(F.col("longitude"), decimals),
        }
    )


def bin_vessel_counts(binned: DataFrame) -> DataFrame:
    """Distinct vessels per cell."""
    return binned.groupBy(CELL).agg(F.count_distinct("mmsi").alias("vessel_count"))


def port_candidates(
    positions: DataFrame, min_vessels: int = MIN_PORT_VESSELS, decimals: int = FINE_DECIMALS
) -> DataFrame:
    """Cells with at least ``min_vessels`` distinct vessels."""
    counts = positions.transform(fine_bins, decimals).transform(bin_vessel_counts)
    return counts.filter(F.col("vessel_count") >= min_vessels)


def candidate_total(candidates: DataFrame) -> DataFrame:
    """Number of candidate cells."""
    return candidates.agg(F.count("*").alias("candidates"))


def coarse_bins(cells: DataFrame, decimals: int = COARSE_DECIMALS) -> DataFrame:
    """Add the coarse cell of each fine cell, rounding the already rounded centre."""
    return cells.withColumns(
        {
            "lat_bin_ports": cell_degrees(F.col("lat_bin"), decimals),
            "lon_bin_ports": cell_degrees(F.col("lon_bin"), decimals),
        }
    )


def coarse_totals(candidates: DataFrame, decimals: int = COARSE_DECIMALS) -> DataFrame:
    """Sum of fine-cell vessel counts per coarse cell; a vessel in two fine cells counts twice."""
    binned = coarse_bins(candidates, decimals)
    return binned.groupBy("lat_bin_ports", "lon_bin_ports").agg(F.sum("vessel_count").alias("vessel_total_count"))


def rename_bins(totals: DataFrame) -> DataFrame:
    """Coarse totals under the column names of fine cells."""
    return totals.select(
        F.col("lat_bin_ports").alias("lat_bin"),
        F.col("lon_bin_ports").alias("lon_bin"),
        F.col("vessel_total_count").alias("vessel_count"),
    )


def coarse_ports(candidates: DataFrame, decimals: int = COARSE_DECIMALS) -> DataFrame:
    """Candidate cells merged on the coarse grid."""
    return candidates.transform(coarse_totals, decimals).transform(rename_bins)


def cell_members(binned: DataFrame) -> DataFrame:
    """Which vessels were in which cell, once each."""
    return binned.select(*CELL, "mmsi").distinct()


def distinct_port_vessels(
    binned: DataFrame, labelled: DataFrame, port: list[str], max_broadcast: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """True number of vessels per port, beside the sum of its cells' counts.

    ``labelled`` has one row per candidate cell: the cell, its ``vessel_count`` and
    the columns ``port`` that name its port. Writes the cells with their ports.
    """
    members = attach(cell_members(binned), labelled.select(*CELL, *port), CELL, max_broadcast=max_broadcast)
    vessels = members.groupBy(port).agg(F.count_distinct("mmsi").alias("distinct_vessels"))
    sums = labelled.groupBy(port).agg(F.sum("vessel_count").alias("vessel_count"))
    return sums.join(vessels, port)


def top_ports(ports: DataFrame, n: int, *tie_break: str) -> DataFrame:
    """The ``n`` ports with most vessels; ``tie_break`` defaults to the place."""
    return ports.orderBy(F.desc("vessel_count"), *(tie_break or CELL)).limit(n)
