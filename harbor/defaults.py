"""Thresholds and names that decide results."""

# The headers of a daily position file and its timestamp format.
REPORT_COLUMNS = {
    "MMSI": "mmsi",
    "# Timestamp": "timestamp_text",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "SOG": "sog",
    "Ship type": "ship_type",
}
TIMESTAMP_FORMAT = "dd/MM/yyyy HH:mm:ss"

# Cleaning and dwelling rules.
EXCLUDED_SHIP_TYPE = "SAR"
SLOW_KNOTS = 0.5
MIN_SLOW_MESSAGES = 5
MAX_DISTANCE_KM = 10.0
EARTH_RADIUS_KM = 6371
MAX_FAST_MESSAGES = 5

# Grids, density clustering, k-means and bubbles.
FINE_DECIMALS = 2
COARSE_DECIMALS = 1
MIN_PORT_VESSELS = 5
DBSCAN_EPS = 0.1
DBSCAN_MIN_SAMPLES = 1
KMEANS_CLUSTERS = (7, 15, 20)
KMEANS_SEED = 1
ELBOW_CLUSTERS = (2, 3, 4, 5, 6, 7, 8, 9)
MIN_CLUSTER_VESSELS = 20
MAX_BUBBLE_RADIUS = 20

# Tuning only, no effect on results.
SLICE_MINUTES = 60  # a vessel's track is cut into slices this long, so that no task holds a whole track
MAX_PIECE_ROWS = 1_000_000  # most messages of one vessel that one task sorts
MAX_BROADCAST_ROWS = 1_000_000  # largest lookup table sent to every executor, in rows
MAX_BROADCAST_BYTES = 64 << 20  # and in bytes at rest
