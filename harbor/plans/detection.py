"""From positions to ports, every method once."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbor.defaults import DBSCAN_EPS, DBSCAN_MIN_SAMPLES, ELBOW_CLUSTERS, KMEANS_SEED, MIN_CLUSTER_VESSELS, MIN_PORT_VESSELS
from harbor.operators import centers as c
from harbor.operators import density, ports, whole_means
from harbor.operators.dwell import stationary_positions
from harbor.operators.report import map_features
from harbor.sources.scratch import materialize


@dataclass(frozen=True)
class GridReport:
    """Ports of one set of positions, by grid and by density."""

    stationary: DataFrame
    candidates: DataFrame
    coarse: DataFrame
    labels: DataFrame
    clusters: DataFrame


@dataclass(frozen=True)
class KMeansReport:
    """Ports of one set of positions, by k-means with one k."""

    centers: DataFrame
    assigned: DataFrame
    counts: DataFrame
    summary: DataFrame
    features: DataFrame


def grid_report(
    positions: DataFrame,
    min_vessels: int = MIN_PORT_VESSELS,
    eps: float = DBSCAN_EPS,
    min_samples: int = DBSCAN_MIN_SAMPLES,
    **dwell,
) -> GridReport:
    """Clean positions to fine, coarse and density ports.

    The vessels are measured once and the candidate cells are written once; all
    later tables start from those. ``dwell`` goes to ``stationary_positions``.
    """
    stationary = stationary_positions(positions, **dwell)
    candidates = materialize(ports.port_candidates(stationary, min_vessels), "candidates")
    labels = materialize(density.dbscan_labels(candidates, eps, min_samples, written=True), "labels")
    return GridReport(
        stationary=stationary,
        candidates=candidates,
        coarse=ports.coarse_ports(candidates),
        labels=labels,
        clusters=density.dbscan_ports(labels),
    )


def kmeans_reports(
    stationary: DataFrame,
    clusters: tuple[int, ...],
    seed: int = KMEANS_SEED,
    min_vessels: int = MIN_CLUSTER_VESSELS,
) -> dict[int, KMeansReport]:
    """One report per number of clusters; all fits share the passes over one written table of weighted places.

    Centres and labels are the same on any partitioning of the rows.
    """
    reports = {}
    places = whole_means.whole_places(stationary)
    fits = whole_means.fit(places, clusters, seed)
    all_centers = whole_means.fitted_centers(places, fits).drop("messages")
    for k, found in fits.items():
        assigned = c.assign_to_centers(stationary, found.centers).drop("d2")
        summary = c.kmeans_summary(assigned, min_vessels)
        reports[k] = KMeansReport(
            centers=all_centers.filter(F.col("k") == k),
            assigned=assigned,
            counts=c.kmeans_cluster_counts(assigned),
            summary=summary,
            features=map_features(summary, label_clusters=True),
        )
    return reports


def suggested_clusters(
    stationary: DataFrame, clusters: tuple[int, ...] = ELBOW_CLUSTERS, seed: int = KMEANS_SEED
) -> DataFrame:
    """The elbow curve of ``stationary`` and the number of clusters at its knee, all fits from shared passes."""
    return c.elbow_choice(whole_means.elbow_costs(whole_means.whole_places(stationary), clusters, seed))
