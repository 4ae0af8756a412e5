"""k-means on message positions, fitted by MLlib, and the same steps on given centres."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harbor.defaults import ELBOW_CLUSTERS, KMEANS_SEED, MIN_CLUSTER_VESSELS
from harbor.sources.scratch import materialize

Centers = list[tuple[float, float]]


def feature_vectors(positions: DataFrame) -> DataFrame:
    """Add the vector ``features`` = (longitude, latitude)."""
    return VectorAssembler(inputCols=["longitude", "latitude"], outputCol="features").transform(positions)


def weighted_places(positions: DataFrame, decimals: int | None = None) -> DataFrame:
    """Distinct places with their number of messages, written once for repeated fits.

    Vessels that lie still report the same place over and over. k-means on places
    weighted by messages minimises the same cost as k-means on the messages. Where
    receivers jitter few places repeat exactly; ``decimals`` rounds coordinates so that
    they do, and the cost is then that of the rounded places.
    """
    if decimals is not None:
        positions = positions.withColumns({name: F.round(name, decimals) for name in ("longitude", "latitude")})
    places = positions.groupBy("longitude", "latitude").agg(F.count("*").cast("double").alias("weight"))
    return feature_vectors(materialize(places, "places"))


@contextmanager
def held(features: DataFrame) -> Iterator[DataFrame]:
    """Keep ``features`` in the executors while several models are fitted."""
    features.persist()
    try:
        yield features
    finally:
        features.unpersist()


def kmeans_fit(features: DataFrame, k: int, seed: int = KMEANS_SEED, weight: str | None = None) -> KMeansModel:
    """Fit ``k`` centres to ``features``, each row counting ``weight`` times."""
    kmeans = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="prediction")
    return (kmeans.setWeightCol(weight) if weight else kmeans).fit(features)


def kmeans_assign(model: KMeansModel, positions: DataFrame) -> DataFrame:
    """Add ``prediction``, the cluster of each message."""
    rows = positions if "features" in positions.columns else feature_vectors(positions)
    return model.transform(rows)


def kmeans_centers(spark: SparkSession, model: KMeansModel) -> DataFrame:
    """Centres of one model, one row per cluster."""
    centers = model.clusterCenters()
    rows = [(len(centers), i, float(lon), float(lat)) for i, (lon, lat) in enumerate(centers)]
    return spark.createDataFrame(rows, "k int, cluster_id int, longitude double, latitude double")


def elbow_models(
    features: DataFrame, clusters: tuple[int, ...] = ELBOW_CLUSTERS, seed: int = KMEANS_SEED, weight: str | None = None
) -> dict[int, KMeansModel]:
    """A model for each number of clusters; ``features`` are read once for all fits."""
    with held(features) as kept:
        return {k: kmeans_fit(kept, k, seed, weight) for k in clusters}


def elbow_costs(
    features: DataFrame, clusters: tuple[int, ...] = ELBOW_CLUSTERS, seed: int = KMEANS_SEED, weight: str | None = None
) -> DataFrame:
    """Training cost for each number of clusters."""
    models = elbow_models(features, clusters, seed, weight)
    rows = [(k, float(model.summary.trainingCost)) for k, model in models.items()]
    return features.sparkSession.createDataFrame(rows, "k int, wssse double")


def model_centers(model: KMeansModel) -> Centers:
    """The centres of a model as (longitude, latitude)."""
    return [(float(lon), float(lat)) for lon, lat in model.clusterCenters()]


def _nearest(centers: Centers) -> Column:
    """Struct of squared distance and number of the nearest centre; the lower number wins ties."""

    def squared(lon: float, lat: float) -> Column:
        dx, dy = F.col("longitude") - lon, F.col("latitude") - lat
        return dx * dx + dy * dy

    return F.array_min(
        F.array([F.struct(squared(*c).alias("d2"), F.lit(i).alias("id")) for i, c in enumerate(centers)])
    )


def assign_to_centers(positions: DataFrame, centers: Centers) -> DataFrame:
    """Add ``prediction`` and squared distance ``d2`` to the nearest of the given (longitude, latitude) centres."""
    nearest = positions.withColumn("nearest", _nearest(centers))
    return nearest.select(
        *positions.columns, F.col("nearest.id").alias("prediction"), F.col("nearest.d2").alias("d2")
    )


def wssse_for_centers(positions: DataFrame, centers: Centers) -> DataFrame:
    """Messages and summed squared distance per given centre."""
    assigned = assign_to_centers(positions, centers)
    return assigned.groupBy(F.col("prediction").alias("cluster_id")).agg(
        F.count("*").alias("messages"), F.sum("d2").alias("wssse")
    )


def costs_for_centers(positions: DataFrame, centers: dict[int, Centers]) -> DataFrame:
    """Messages and summed squared distance to the nearest centre, for several sets of centres in one pass."""
    costs = F.array(
        *(
            F.struct(F.lit(k).alias("k"), F.count("*").alias("messages"), F.sum(_nearest(places)["d2"]).alias("wssse"))
            for k, places in centers.items()
        )
    )
    return positions.agg(costs.alias("costs")).select(F.inline("costs"))


def elbow_choice(costs: DataFrame) -> DataFrame:
    """``costs(k, wssse)`` with ``below_chord`` and ``chosen``: the number of clusters at the knee of the curve.

    The chord joins the costs of the least and the greatest k, both axes scaled to one.
    The knee lies furthest from it, which is where the curve is furthest below it; the lesser k
    on a tie (to twelve digits). A single k, or costs that do not fall, have no knee: the least k is chosen.
    """
    curve = costs.agg(F.array_sort(F.collect_list(F.struct("k", "wssse"))).alias("curve"))  # a row for each k tried
    first, last = F.element_at("curve", 1), F.element_at("curve", -1)
    fall = F.when(first["wssse"] > last["wssse"], first["wssse"] - last["wssse"])
    steps = F.when(last["k"] > first["k"], last["k"] - first["k"])

    def below(point: Column) -> Column:
        gap = 1 - (point["k"] - first["k"]) / steps - (point["wssse"] - last["wssse"]) / fall
        return F.struct(point["k"].alias("k"), point["wssse"].alias("wssse"), F.coalesce(F.round(gap, 12), F.lit(0.0)).alias("below_chord"))

    placed = curve.filter(F.size("curve") > 0).select(F.transform("curve", below).alias("curve"))
    furthest = F.array_max(F.transform("curve", lambda point: point["below_chord"]))
    knee = F.element_at(F.filter("curve", lambda point: point["below_chord"] == furthest), 1)["k"]
    rows = placed.select(F.inline("curve"), knee.alias("knee"))
    return rows.select("k", "wssse", "below_chord", (F.col("k") == F.col("knee")).alias("chosen"))


def kmeans_cluster_counts(assigned: DataFrame) -> DataFrame:
    """Distinct vessels per cluster."""
    return assigned.groupBy("prediction").agg(F.count_distinct("mmsi").alias("ship_count"))


def kmeans_summary(assigned: DataFrame, min_vessels: int = MIN_CLUSTER_VESSELS) -> DataFrame:
    """Per cluster with enough vessels: distinct vessels and mean place of its messages."""
    summary = assigned.groupBy("prediction").agg(
        F.count_distinct("mmsi").alias("vessel_count"),
        F.avg("latitude").alias("lat_bin"),
        F.avg("longitude").alias("lon_bin"),
    )
    return summary.withColumnRenamed("prediction", "cluster_id").filter(F.col("vessel_count") >= min_vessels)
