"""Distances on the earth and cells of a degree grid."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from harbor.defaults import EARTH_RADIUS_KM


def haversine_km(from_lat: Column, from_lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Great-circle distance in kilometres; null when any coordinate is null."""

    def half_chord(start: Column, end: Column) -> Column:
        return F.pow(F.sin(F.radians(end - start) / 2), F.lit(2.0))

    chord = half_chord(from_lat, to_lat) + (
        F.cos(F.radians(from_lat)) * F.cos(F.radians(to_lat)) * half_chord(from_lon, to_lon)
    )
    # Rounding can push the chord of antipodes above 1, and least() would turn null into 1.
    return F.asin(F.sqrt(F.when(chord > 1.0, 1.0).otherwise(chord))) * (2 * EARTH_RADIUS_KM)


def cell_degrees(degrees: Column, decimals: int) -> Column:
    """Centre of the grid cell that holds ``degrees``, rounding half up."""
    return F.round(degrees, decimals)


def cell_index(centre: Column, decimals: int) -> Column:
    """Whole-number index of a cell centre on a grid of ``decimals`` places."""
    return F.round(centre * 10**decimals).cast("long")
