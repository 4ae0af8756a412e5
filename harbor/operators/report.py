"""Tables to look at and bubbles to draw."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbor.defaults import MAX_BUBBLE_RADIUS
from harbor.operators.ports import top_ports


def preview(positions: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` messages by vessel and time."""
    return positions.orderBy("mmsi", "ts", "latitude", "longitude").limit(n)


def ship_type_histogram(positions: DataFrame) -> DataFrame:
    """Messages per ship type, largest first."""
    return positions.groupBy("ship_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "ship_type")


def map_center(ports: DataFrame) -> DataFrame:
    """Unweighted mean place of the ports shown."""
    return ports.agg(F.avg("lat_bin").alias("center_lat"), F.avg("lon_bin").alias("center_lon"))


def map_features(ports: DataFrame, label_clusters: bool = False) -> DataFrame:
    """One bubble per port: place, radius and popup text; ``label_clusters`` adds the cluster id."""
    parts = [F.lit("Vessels: "), F.col("vessel_count").cast("string")]
    if label_clusters:
        parts += [F.lit(", Cluster: "), F.col("cluster_id").cast("string")]
    return ports.select(
        F.col("lat_bin").alias("lat"),
        F.col("lon_bin").alias("lon"),
        F.least("vessel_count", F.lit(MAX_BUBBLE_RADIUS)).cast("int").alias("radius"),
        F.concat(*parts).alias("popup"),
    )


def geojson_features(features: DataFrame) -> DataFrame:
    """Bubbles as GeoJSON point features, one text per row."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return features.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                point.alias("geometry"),
                F.struct("radius", "popup").alias("properties"),
            )
        ).alias("feature")
    )


def port_size_range(ports: DataFrame, method: str, top: int = 5) -> DataFrame:
    """Smallest and largest port of one method, over all of its ports and over its ``top`` ones."""

    def span(some: DataFrame, scope: str) -> DataFrame:
        return some.agg(
            F.count("*").alias("ports"),
            F.min("vessel_count").alias("min_vessels"),
            F.max("vessel_count").alias("max_vessels"),
        ).select(F.lit(method).alias("method"), F.lit(scope).alias("scope"), "ports", "min_vessels", "max_vessels")

    largest = top_ports(ports.select("vessel_count", "lat_bin", "lon_bin"), top)
    return span(ports, "all").unionByName(span(largest, f"top {top}"))
