"""Vessels of grid cells as exact bitmaps that roll up to any union of cells.

Vessels are numbered once. A cell keeps the numbers of its vessels as bitmaps, one row
for each 32,768 numbers that occur. The vessels of a port are the OR of the bitmaps of
its cells, so a vessel in several cells counts once, and positions are scanned once
however many kinds of ports are made of the cells.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbor.defaults import MAX_BROADCAST_ROWS, MIN_PORT_VESSELS
from harbor.operators.lookup import attach
from harbor.operators.ports import CELL
from harbor.sources.scratch import materialize

BITMAP = "vessels"
SPAN = "span"  # which 32,768 numbers a bitmap stands for


def vessel_numbers(positions: DataFrame) -> DataFrame:
    """Every vessel with a number of its own, from 1 on, written once. Numbers of a part of the vessels follow each other."""
    vessels = positions.select("mmsi").distinct()
    return materialize(vessels.select("mmsi", (F.monotonically_increasing_id() + 1).alias("number")), "vessels")


def cell_vessels(binned: DataFrame, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row for each cell and span of vessel numbers: the bitmap of the vessels there. Written once.

    A vessel counts once per cell before any bitmap is built, so a crowded cell is no hot key.
    """
    members = materialize(binned.select(*CELL, "mmsi").distinct(), "members")
    numbered = attach(members, vessel_numbers(members), ["mmsi"], max_broadcast=max_broadcast)
    spans = numbered.groupBy(*CELL, F.bitmap_bucket_number("number").alias(SPAN))
    return materialize(spans.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias(BITMAP)), "cells")


def united(cells: DataFrame, key: list[str]) -> DataFrame:
    """The bitmaps of unions of cells, or of unions of unions, that share ``key``."""
    return cells.groupBy(*key, SPAN).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def vessel_counts(cells: DataFrame, key: list[str], name: str = "vessel_count") -> DataFrame:
    """Number of distinct vessels per ``key``, of bitmaps that are united by it."""
    return cells.groupBy(*key).agg(F.sum(F.bitmap_count(BITMAP)).alias(name))


def candidate_cells(cells: DataFrame, min_vessels: int = MIN_PORT_VESSELS) -> DataFrame:
    """Cells with enough vessels, as ``port_candidates`` gives them, from the bitmaps."""
    return vessel_counts(cells, CELL).filter(F.col("vessel_count") >= min_vessels)


def port_vessels(cells: DataFrame, labelled: DataFrame, port: list[str]) -> DataFrame:
    """True number of vessels per port, beside the sum of its cells' counts.

    ``labelled`` has one row per cell: the cell, its ``vessel_count`` and the columns ``port``.
    """
    parts = united(cells.join(labelled.select(*CELL, *port), CELL), port)
    sums = labelled.groupBy(port).agg(F.sum("vessel_count").alias("vessel_count"))
    return sums.join(vessel_counts(parts, port, "distinct_vessels"), port)
