"""Queries of the library on the given tables, and the SQL that checks them.

The tables hold no ship positions, so ``harbor.sources.events`` derives them from
``events``. Sums and means of doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_texts  # noqa: E402
from harbor.defaults import ELBOW_CLUSTERS  # noqa: E402
from harbor.operators import centers, clean, density, dwell, globe, history, members, ports, report, track, whole_means  # noqa: E402
from harbor.plans import detection  # noqa: E402
from harbor.sources import by_vessel, events, reports, scratch  # noqa: E402

try:  # the text operators may be absent
    import corpus_pipeline
    from harbor.llm import oracles as text_oracles
    from harbor.llm import queries as text_queries
except ImportError as absent:
    if not (absent.name or "").startswith(("corpus_pipeline", "harbor.llm")):  # a broken library is an error
        raise
    corpus_pipeline = text_oracles = text_queries = None

Query = Callable[[SparkSession, str], DataFrame]

GIVEN_CENTERS = oracle_texts.GIVEN_CENTERS
FAST_MESSAGES_KEPT = oracle_texts.FAST_MESSAGES_KEPT
ELBOW_CENTERS = oracle_texts.ELBOW_CENTERS
SPARSE_EPS, SPARSE_MIN_SAMPLES = oracle_texts.SPARSE_EPS, oracle_texts.SPARSE_MIN_SAMPLES
GLOBE_EPS_KM, GLOBE_SPARSE_KM = oracle_texts.GLOBE_EPS_KM, oracle_texts.GLOBE_SPARSE_KM
FITTED_CLUSTERS = 7
STORED_BUCKETS = 8
REPORTED_CLUSTERS = (7, 15, 20)


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return events.raw_reports(events.positions_table(spark, sf))


def projected(spark: SparkSession, sf: str) -> DataFrame:
    return clean.project_columns(raw(spark, sf))


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return events.positions_table(spark, sf)


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_typed(typed(spark, sf))


def slow(spark: SparkSession, sf: str) -> DataFrame:
    return dwell.low_speed(cleaned(spark, sf))


def slow_of_dwelling(spark: SparkSession, sf: str) -> DataFrame:
    return dwell.slow_positions(slow(spark, sf))


def stationary(spark: SparkSession, sf: str) -> DataFrame:
    return dwell.stationary_positions(cleaned(spark, sf))


def stationary_vessel_days(spark: SparkSession, sf: str) -> DataFrame:
    by_day = dwell.low_speed(track.with_day(cleaned(spark, sf)))
    return rounded(dwell.stationary_vessels(by_day, min_messages=2, vessel=track.VESSEL_DAY), "total_distance_km")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return ports.port_candidates(stationary(spark, sf))


def dbscan_ports(spark: SparkSession, sf: str) -> DataFrame:
    return density.dbscan_ports(density.dbscan_labels(candidates(spark, sf)))


def on_given_centers(spark: SparkSession, sf: str) -> DataFrame:
    return centers.assign_to_centers(stationary(spark, sf), GIVEN_CENTERS)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in columns})


def ais_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.scratch_path(spark, "reports")
    reports.write_reports(raw(spark, sf), path)
    return clean.project_columns(reports.read_reports(spark, path))


def cell_vessels(spark: SparkSession, sf: str) -> DataFrame:
    return members.cell_vessels(ports.fine_bins(stationary(spark, sf)))


def coarse_port_vessels(spark: SparkSession, sf: str) -> DataFrame:
    cells = cell_vessels(spark, sf)
    labelled = ports.coarse_bins(scratch.materialize(members.candidate_cells(cells), "candidates"))
    return members.port_vessels(cells, labelled, ["lat_bin_ports", "lon_bin_ports"])


def dbscan_port_vessels(spark: SparkSession, sf: str) -> DataFrame:
    cells = cell_vessels(spark, sf)
    labels = density.dbscan_labels(scratch.materialize(members.candidate_cells(cells), "candidates"), written=True)
    return members.port_vessels(cells, scratch.materialize(labels, "labels"), ["cluster"])


def stored_history(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of all days, stored in two goes: the later days first."""
    path = scratch.scratch_path(spark, "history")
    spans = scratch.materialize(history.day_spans(slow(spark, sf)), "spans")
    later = F.dayofyear("day") % 2 == 0
    for part in (later, ~later):
        history.store_days(spans.filter(part), path)
    return history.read_days(spark, path)


def stored_distance(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.scratch_path(spark, "by_vessel")
    name = f"by_vessel_{path.rpartition('-')[2]}"
    by_vessel.store_by_vessel(cleaned(spark, sf), name, path, STORED_BUCKETS)
    return rounded(by_vessel.stored_distance(by_vessel.read_by_vessel(spark, name)), "total_distance_km")


def history_distance(spark: SparkSession, sf: str) -> DataFrame:
    tracks = history.history_tracks(stored_history(spark, sf)).filter(dwell.dwells())
    return rounded(tracks.select("mmsi", "total_distance_km").dropna(), "total_distance_km")


def three_means(spark: SparkSession, sf: str) -> tuple[centers.KMeansModel, DataFrame]:
    """Three centres for the three far-apart ports: the one case where every start ends alike."""
    rows = stationary(spark, sf)
    return centers.kmeans_fit(centers.weighted_places(rows), 3, weight="weight"), rows


def by_longitude(model: centers.KMeansModel, cluster: str) -> Column:
    """Clusters are numbered by chance; here by their centre from west to east."""
    places = [lon for lon, _ in centers.model_centers(model)]
    return F.array(*(F.lit(sorted(places).index(lon)) for lon in places))[F.col(cluster)]


def three_assigned(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = three_means(spark, sf)
    assigned = centers.kmeans_assign(model, rows).drop("features")
    return assigned.withColumn("prediction", by_longitude(model, "prediction"))


def kmeans_centers(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = three_means(spark, sf)
    found = rounded(centers.kmeans_centers(spark, model), "longitude", "latitude")
    return found.withColumn("cluster_id", by_longitude(model, "cluster_id"))


def fit_facts(assigned: DataFrame, places: centers.Centers, k: int) -> DataFrame:
    """What holds for any fit: all messages are in some of k clusters, each in that of its nearest centre."""
    near = centers.assign_to_centers(assigned.withColumnRenamed("prediction", "cluster"), places)
    own = F.array(*(F.struct(F.lit(lon).alias("lon"), F.lit(lat).alias("lat")) for lon, lat in places))[F.col("cluster")]
    d2 = F.pow(F.col("longitude") - own["lon"], 2) + F.pow(F.col("latitude") - own["lat"], 2)
    return near.agg(
        F.lit(k).alias("k"), F.count("*").alias("messages"), F.count_distinct("mmsi").alias("vessels"),
        F.count_distinct("cluster").between(1, k).alias("clusters_within"),
        F.every(d2 <= F.col("d2") + 1e-6).alias("nearest"),
    )


def kmeans_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = stationary(spark, sf)
    model = centers.kmeans_fit(centers.weighted_places(rows), FITTED_CLUSTERS, weight="weight")
    return fit_facts(centers.kmeans_assign(model, rows), centers.model_centers(model), FITTED_CLUSTERS)


def kmeans_reports(spark: SparkSession, sf: str) -> DataFrame:
    facts = []
    for k, found in detection.kmeans_reports(stationary(spark, sf), REPORTED_CLUSTERS, min_vessels=1).items():
        places = [(r.longitude, r.latitude) for r in found.centers.orderBy("cluster_id").collect()]
        facts.append(fit_facts(found.assigned, places, k))
    return reduce(DataFrame.unionByName, facts)


def kmeans_message_fit(spark: SparkSession, sf: str) -> DataFrame:
    costs = centers.elbow_costs(centers.feature_vectors(stationary(spark, sf)), clusters=(3,))
    return costs.select("k", F.round("wssse", 3).alias("wssse"))


def elbow_costs(spark: SparkSession, sf: str) -> DataFrame:
    """The costs reported for 2 to 9 clusters against those of their centres over all messages."""
    rows = stationary(spark, sf)
    fits = whole_means.fit(whole_means.whole_places(rows), ELBOW_CLUSTERS)
    reported = F.create_map(*(F.lit(x) for k, found in fits.items() for x in (k, found.wssse)))[F.col("k")]
    costs = centers.costs_for_centers(rows, {k: found.centers for k, found in fits.items()})
    agrees = F.abs(F.col("wssse") - reported) <= 1e-6 * reported
    three = F.when(F.col("k") == 3, F.round("wssse", 3))
    return costs.select("k", "messages", agrees.alias("agrees"), three.alias("wssse_of_three"))


def elbow_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The knee among the costs of the first 1 to 9 of given centres."""
    sets = {k: ELBOW_CENTERS[:k] for k in range(1, len(ELBOW_CENTERS) + 1)}
    curve = centers.elbow_choice(centers.costs_for_centers(stationary(spark, sf), sets))
    return rounded(curve, "wssse", "below_chord")


def kmeans_whole_centers(spark: SparkSession, sf: str) -> DataFrame:
    """Three centres by whole numbers, numbered from west to east, with their messages and their common cost."""
    [(k, found)] = whole_means.fit(whole_means.whole_places(stationary(spark, sf)), (3,)).items()
    west = sorted(zip(found.centers, found.messages, strict=True))
    rows = [(k, n, lon, lat, messages, round(found.wssse, 3)) for n, ((lon, lat), messages) in enumerate(west)]
    return spark.createDataFrame(rows, "k int, cluster_id int, longitude double, latitude double, messages long, wssse double")


def kmeans_three_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = centers.kmeans_summary(three_assigned(spark, sf))
    return rounded(summary, "lat_bin", "lon_bin").drop("cluster_id")


def kmeans_three_cost(spark: SparkSession, sf: str) -> DataFrame:
    places = centers.weighted_places(stationary(spark, sf))
    costs = centers.elbow_costs(places, clusters=(3,), weight="weight")
    return costs.select("k", F.round("wssse", 3).alias("wssse"))


def map_features_written(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.scratch_path(spark, "map")
    features = report.map_features(candidates(spark, sf))
    reports.write_map_features(features, path)
    return spark.read.schema(features.schema).json(path)


def port_size_range(spark: SparkSession, sf: str) -> DataFrame:
    found = detection.grid_report(cleaned(spark, sf))
    by_center = centers.kmeans_summary(centers.assign_to_centers(found.stationary, GIVEN_CENTERS))
    spans = report.port_size_range(found.candidates, "fine grid")
    spans = spans.unionByName(report.port_size_range(found.coarse, "coarse grid"))
    spans = spans.unionByName(report.port_size_range(found.clusters, "dbscan"))
    return spans.unionByName(report.port_size_range(by_center, "given centers"))


def entry(spark: SparkSession, folder: str = "/root/testdata/sf0.001") -> DataFrame:
    """Fine-grid ports of the tables in ``folder``, largest first."""
    found = ports.port_candidates(stationary(spark, folder), min_vessels=2)
    return found.orderBy(F.desc("vessel_count"), "lat_bin", "lon_bin")


def queries() -> dict[str, Query]:
    """One entry per operator."""
    return position_queries() | (_text_queries() if text_queries else {})


def _text_queries() -> dict[str, Query]:
    return text_queries.queries() | {"pipeline": corpus_pipeline.run}


def position_queries() -> dict[str, Query]:
    return {
        # Sources, projections and filters
        "ais_scan": ais_scan,
        "preview": lambda s, d: report.preview(cleaned(s, d)),
        "project_columns": projected,
        "drop_incomplete": lambda s, d: clean.drop_incomplete(projected(s, d)),
        "cast_numeric": lambda s, d: clean.cast_numeric(
            projected(s, d).withColumns({n: F.col(n).cast("string") for n in ("latitude", "longitude", "sog")})
        ),
        "parse_timestamp": lambda s, d: clean.parse_timestamp(projected(s, d)).select("mmsi", "timestamp_text", "ts"),
        "valid_coordinates": lambda s, d: clean.valid_coordinates(typed(s, d)),
        "exclude_ship_type": lambda s, d: clean.exclude_ship_type(typed(s, d)),
        "clean_positions": lambda s, d: clean.clean_positions(raw(s, d)),
        "low_speed": slow,
        "rename_bins": lambda s, d: ports.rename_bins(ports.coarse_totals(candidates(s, d))),
        # Joins and aggregations
        "slow_positions": slow_of_dwelling,
        "stationary_positions": lambda s, d: rounded(stationary(s, d), "total_distance_km"),
        "low_speed_counts": lambda s, d: dwell.low_speed_counts(slow(s, d)),
        "dwelling_vessels": lambda s, d: dwell.dwelling_vessels(slow(s, d)),
        "stored_distance": stored_distance,
        "history_distance": history_distance,
        "history_stationary_vessels": lambda s, d: rounded(
            history.stationary_in_history(stored_history(s, d)), "total_distance_km"
        ),
        "vessel_total": lambda s, d: dwell.vessel_total(stationary(s, d)),
        "vessel_distance": lambda s, d: rounded(dwell.vessel_distance(slow(s, d)), "total_distance_km"),
        "stationary_vessels": lambda s, d: rounded(dwell.stationary_vessels(slow(s, d)), "total_distance_km"),
        "stationary_vessel_days": stationary_vessel_days,
        "ship_type_histogram": lambda s, d: report.ship_type_histogram(stationary(s, d)),
        "mover_exclusion": lambda s, d: dwell.mover_exclusion(cleaned(s, d), FAST_MESSAGES_KEPT),
        # Tracks
        "previous_position": lambda s, d: track.previous_position(slow_of_dwelling(s, d)),
        "segment_distance": lambda s, d: rounded(
            track.segment_distance(track.previous_position(slow_of_dwelling(s, d))), "segment_km"
        ),
        # Grids
        "fine_bins": lambda s, d: rounded(ports.fine_bins(stationary(s, d)), "total_distance_km"),
        "bin_vessel_counts": lambda s, d: ports.bin_vessel_counts(ports.fine_bins(stationary(s, d))),
        "cell_vessel_counts": lambda s, d: members.vessel_counts(cell_vessels(s, d), ports.CELL),
        "port_candidates": candidates,
        "candidate_total": lambda s, d: ports.candidate_total(candidates(s, d)),
        "top_port_candidates": lambda s, d: ports.top_ports(candidates(s, d), 5),
        "coarse_bins": lambda s, d: ports.coarse_bins(candidates(s, d)),
        "coarse_ports": lambda s, d: ports.coarse_ports(candidates(s, d)),
        "top_coarse_ports": lambda s, d: ports.top_ports(ports.coarse_ports(candidates(s, d)), 20),
        "coarse_port_vessels": coarse_port_vessels,
        # Density clustering
        "dbscan_labels": lambda s, d: density.dbscan_labels(candidates(s, d)),
        "dbscan_core_border_noise": lambda s, d: density.dbscan_labels(
            candidates(s, d), SPARSE_EPS, SPARSE_MIN_SAMPLES
        ),
        "dbscan_globe": lambda s, d: globe.dbscan_globe(candidates(s, d), GLOBE_EPS_KM),
        "dbscan_globe_roles": lambda s, d: globe.dbscan_globe(candidates(s, d), GLOBE_SPARSE_KM, SPARSE_MIN_SAMPLES),
        "dbscan_ports": lambda s, d: rounded(dbscan_ports(s, d), "lat_bin", "lon_bin"),
        "top_dbscan_ports": lambda s, d: rounded(density.top_dbscan_ports(dbscan_ports(s, d)), "lat_bin", "lon_bin"),
        "dbscan_port_vessels": dbscan_port_vessels,
        # k-means: checked are given centres, the one fit that ends alike from every start (three far-apart
        # ports), and what holds for every fit. MLlib's centres depend on partitioning, those in whole numbers do not.
        "feature_vectors": lambda s, d: _features_as_columns(centers.feature_vectors(stationary(s, d))),
        "kmeans_fit": kmeans_fit,
        "kmeans_reports": kmeans_reports,
        "kmeans_message_fit": kmeans_message_fit,
        "kmeans_centers": kmeans_centers,
        "kmeans_assign": lambda s, d: rounded(three_assigned(s, d), "total_distance_km"),
        "kmeans_cluster_counts": lambda s, d: centers.kmeans_cluster_counts(three_assigned(s, d)),
        "kmeans_summary": lambda s, d: rounded(
            centers.kmeans_summary(three_assigned(s, d)), "lat_bin", "lon_bin"
        ),
        "kmeans_map_features": lambda s, d: rounded(
            report.map_features(centers.kmeans_summary(three_assigned(s, d)), label_clusters=True), "lat", "lon"
        ),
        "elbow_costs": elbow_costs,
        "elbow_choice": elbow_choice,
        "kmeans_whole_centers": kmeans_whole_centers,
        "kmeans_three_summary": kmeans_three_summary,
        "kmeans_three_cost": kmeans_three_cost,
        "assign_to_centers": lambda s, d: rounded(on_given_centers(s, d), "total_distance_km", "d2"),
        "wssse_for_centers": lambda s, d: rounded(
            centers.wssse_for_centers(stationary(s, d), GIVEN_CENTERS), "wssse"
        ),
        "given_centers_cluster_counts": lambda s, d: centers.kmeans_cluster_counts(on_given_centers(s, d)),
        "given_centers_summary": lambda s, d: rounded(
            centers.kmeans_summary(on_given_centers(s, d)), "lat_bin", "lon_bin"
        ),
        "given_centers_map_features": lambda s, d: rounded(
            report.map_features(centers.kmeans_summary(on_given_centers(s, d)), label_clusters=True), "lat", "lon"
        ),
        # Reports
        "port_size_range": port_size_range,
        "map_center": lambda s, d: rounded(report.map_center(candidates(s, d)), "center_lat", "center_lon"),
        "map_features": lambda s, d: report.map_features(candidates(s, d)),
        "map_features_written": map_features_written,
        "geojson_features": lambda s, d: report.geojson_features(report.map_features(candidates(s, d))),
    }


def _features_as_columns(vectors: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    parts = vector_to_array("features")
    return vectors.select("mmsi", "ts", parts[0].alias("feature_0"), parts[1].alias("feature_1"))


def oracle_sql() -> dict[str, str]:
    """SQL for every query that SQL can express."""
    texts = oracle_texts.texts()
    if text_queries:
        texts |= text_oracles.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            texts["pipeline"] = corpus_pipeline.ORACLE_SQL
    return texts
