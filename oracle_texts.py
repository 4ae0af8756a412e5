"""SQL twins of the queries, written independently of the operators.

Plain window and join forms. Apart from ``strftime`` they are valid in Spark too.
"""

from harbor.sources.events import POSITIONS_SQL

# (longitude, latitude), one near each of the three ports of the derived positions.
GIVEN_CENTERS = [(8.504, 54.624), (10.004, 55.124), (11.504, 55.664)]
# The same and six more, in the order in which they are added.
ELBOW_CENTERS = [*GIVEN_CENTERS, (8.505, 54.665), (11.505, 55.785), (10.005, 55.165), (8.51, 54.62), (11.51, 55.66), (10.01, 55.12)]
# The documented rule of at most 5 fast messages keeps no vessel of the derived positions.
FAST_MESSAGES_KEPT = 12
# Cells one step apart are near; four near cells, itself included, make a core cell.
SPARSE_EPS, SPARSE_MIN_SAMPLES = 0.01, 4
GLOBE_EPS_KM, GLOBE_SPARSE_KM = 8.0, 1.2

CTES = {
    "positions": POSITIONS_SQL.format(events="events"),
    "raw": """SELECT mmsi, strftime(ts, '%d/%m/%Y %H:%M:%S') AS timestamp_text, latitude, longitude, sog, ship_type
        FROM positions""",
    "clean": """SELECT * FROM positions
        WHERE mmsi IS NOT NULL AND ts IS NOT NULL
          AND latitude IS NOT NULL AND NOT isnan(latitude) AND longitude IS NOT NULL AND NOT isnan(longitude)
          AND sog IS NOT NULL AND NOT isnan(sog)
          AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND ship_type <> 'SAR'""",
    "slow": "SELECT * FROM clean WHERE sog < 0.5",
    "counts": "SELECT mmsi, count(*) AS low_speed_msgs FROM slow GROUP BY mmsi",
    "dwelling": "SELECT * FROM counts WHERE low_speed_msgs >= 5",
    "slow_positions": "SELECT slow.*, low_speed_msgs FROM slow JOIN dwelling ON slow.mmsi = dwelling.mmsi",
    "lagged": """SELECT *, lag(latitude) OVER w AS prev_lat, lag(longitude) OVER w AS prev_lon FROM slow_positions
        WINDOW w AS (PARTITION BY mmsi ORDER BY ts, latitude, longitude)""",
    "steps": "SELECT * FROM lagged WHERE prev_lat IS NOT NULL AND prev_lon IS NOT NULL",
    "segments": """SELECT *, 2 * 6371 * asin(sqrt(least(1.0E0,
            power(sin(radians(latitude - prev_lat) / 2), 2) + cos(radians(prev_lat)) * cos(radians(latitude))
            * power(sin(radians(longitude - prev_lon) / 2), 2)))) AS segment_km FROM steps""",
    "distance": "SELECT mmsi, sum(segment_km) AS total_distance_km FROM segments GROUP BY mmsi",
    "near": "SELECT * FROM distance WHERE total_distance_km < 10.0",
    "stationary": """SELECT slow_positions.*, total_distance_km
        FROM slow_positions JOIN near ON slow_positions.mmsi = near.mmsi""",
    "binned": "SELECT *, round(latitude, 2) AS lat_bin, round(longitude, 2) AS lon_bin FROM stationary",
    "bins": "SELECT lat_bin, lon_bin, count(DISTINCT mmsi) AS vessel_count FROM binned GROUP BY lat_bin, lon_bin",
    "candidates": "SELECT * FROM bins WHERE vessel_count >= 5",
    "coarse_binned": """SELECT *, round(lat_bin, 1) AS lat_bin_ports, round(lon_bin, 1) AS lon_bin_ports
        FROM candidates""",
    "coarse": """SELECT lat_bin_ports AS lat_bin, lon_bin_ports AS lon_bin,
            CAST(sum(vessel_count) AS BIGINT) AS vessel_count
        FROM coarse_binned GROUP BY lat_bin_ports, lon_bin_ports""",
    "cells": """SELECT *, CAST(round(lat_bin * 100) AS BIGINT) AS x, CAST(round(lon_bin * 100) AS BIGINT) AS y
        FROM candidates""",
    "points": "SELECT *, (x + 9000) * 36001 + y + 18000 AS point FROM cells",
    "distances": """SELECT stationary.*, c.id, power(longitude - c.lon, 2) + power(latitude - c.lat, 2) AS d2
        FROM stationary CROSS JOIN (VALUES {centers}) AS c(id, lon, lat)""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY mmsi, ts, latitude, longitude, sog ORDER BY d2, id) AS place
        FROM distances""",
    "assigned": "SELECT * EXCLUDE (id, place), id AS prediction FROM ranked WHERE place = 1",
    "summary": """SELECT prediction AS cluster_id, count(DISTINCT mmsi) AS vessel_count,
            avg(latitude) AS lat_bin, avg(longitude) AS lon_bin
        FROM assigned GROUP BY prediction HAVING count(DISTINCT mmsi) >= 20""",
}
CTES["distances"] = CTES["distances"].format(
    centers=", ".join(f"({i}, {lon}E0, {lat}E0)" for i, (lon, lat) in enumerate(GIVEN_CENTERS))
)

# Clusters of candidate cells: cells reachable from each core cell, for one reach and one density.
NEAR_BY_DEGREES = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {}"
NEAR_BY_KM = """2 * 6371 * asin(sqrt(least(1.0E0, power(sin(radians(a.lat_bin - b.lat_bin) / 2), 2)
    + cos(radians(a.lat_bin)) * cos(radians(b.lat_bin)) * power(sin(radians(a.lon_bin - b.lon_bin) / 2), 2)))) <= {}"""
DBSCAN = """near_cells AS (SELECT a.point, b.point AS other FROM points a JOIN points b ON {near}),
core AS (SELECT point FROM near_cells GROUP BY point HAVING count(*) >= {min_samples}),
links AS (SELECT point, other FROM near_cells
    WHERE point IN (SELECT point FROM core) AND other IN (SELECT point FROM core)),
reached AS (
    SELECT point, point AS other FROM core
    UNION
    SELECT reached.point, links.other FROM reached JOIN links ON reached.other = links.point),
core_labels AS (SELECT point, min(other) AS cluster FROM reached GROUP BY point),
border_labels AS (
    SELECT near_cells.point, min(cluster) AS cluster
    FROM near_cells JOIN core_labels ON near_cells.other = core_labels.point
    WHERE near_cells.point NOT IN (SELECT point FROM core) GROUP BY near_cells.point),
labelled AS (
    SELECT lat_bin, lon_bin, vessel_count,
           CASE WHEN c.point IS NOT NULL THEN 'core' WHEN b.point IS NOT NULL THEN 'border' ELSE 'noise' END AS role,
           CAST(coalesce(c.cluster, b.cluster, -1) AS BIGINT) AS cluster
    FROM points LEFT JOIN core_labels c ON points.point = c.point LEFT JOIN border_labels b ON points.point = b.point),
dbscan AS (
    SELECT cluster, avg(lat_bin) AS lat_bin, avg(lon_bin) AS lon_bin, CAST(sum(vessel_count) AS BIGINT) AS vessel_count
    FROM labelled GROUP BY cluster)
"""


def _with(select: str, dbscan: tuple[float, int] | None = None, near: str = NEAR_BY_DEGREES) -> str:
    parts = [f"{name} AS (\n{text}\n)" for name, text in CTES.items()]
    if dbscan:
        parts.append(DBSCAN.format(near=near.format(dbscan[0]), min_samples=dbscan[1]))
    return f"WITH {'RECURSIVE ' if dbscan else ''}{', '.join(parts)}\n{select}"


def on_stored_positions(query: str, table: str) -> str:
    """The SQL of a query that ends at one of the relations above, reading positions from ``table``."""
    relation = {
        "stationary_positions": "stationary",
        "port_candidates": "candidates",
        "vessel_distance": "distance",
        "previous_position": "steps",
    }[query]
    names = list(CTES)
    needed = [name for name in names[: names.index(relation) + 1] if name not in ("positions", "raw")]
    parts = [f"positions AS (SELECT * FROM {table})", *(f"{name} AS (\n{CTES[name]}\n)" for name in needed)]
    return f"WITH {', '.join(parts)}\nSELECT * FROM {relation}"


def _span(table: str, method: str) -> str:
    values = "count(*) AS ports, min(vessel_count) AS min_vessels, max(vessel_count) AS max_vessels"
    largest = f"(SELECT vessel_count FROM {table} ORDER BY vessel_count DESC LIMIT 5)"
    return (
        f"SELECT '{method}' AS method, 'all' AS scope, {values} FROM {table} "
        f"UNION ALL SELECT '{method}', 'top 5', {values} FROM {largest} AS largest"
    )


def _elbow_values() -> str:
    return ", ".join(f"({n}, {lon}E0, {lat}E0)" for n, (lon, lat) in enumerate(ELBOW_CENTERS, 1))


def texts() -> dict[str, str]:
    """One SQL text per query."""
    report_columns = "mmsi, timestamp_text, latitude, longitude, sog, ship_type"
    stationary_columns = """mmsi, ts, latitude, longitude, sog, ship_type, low_speed_msgs,
        round(total_distance_km, 6) AS total_distance_km"""
    bubbles = """SELECT lat_bin AS lat, lon_bin AS lon, CAST(least(vessel_count, 20) AS INTEGER) AS radius,
        'Vessels: ' || vessel_count AS popup FROM candidates"""
    fit_facts = """count(*) AS messages, count(DISTINCT mmsi) AS vessels, TRUE AS clusters_within,
        TRUE AS nearest"""
    three_cost = """(SELECT round(sum(spread), 3) FROM (
        SELECT (var_pop(latitude) + var_pop(longitude)) * count(*) AS spread FROM assigned GROUP BY prediction))"""
    dense = (100, 1)
    sparse = (1, SPARSE_MIN_SAMPLES)
    return {
        "ais_scan": _with(f"SELECT {report_columns} FROM raw"),
        "preview": _with("SELECT * FROM clean ORDER BY mmsi, ts, latitude, longitude LIMIT 5"),
        "project_columns": _with(f"SELECT {report_columns} FROM raw"),
        "drop_incomplete": _with(
            f"""SELECT {report_columns} FROM raw WHERE mmsi IS NOT NULL AND timestamp_text IS NOT NULL
            AND latitude IS NOT NULL AND NOT isnan(latitude) AND longitude IS NOT NULL AND NOT isnan(longitude)
            AND sog IS NOT NULL AND NOT isnan(sog)"""
        ),
        "cast_numeric": _with(f"SELECT {report_columns} FROM raw"),
        "parse_timestamp": _with(
            "SELECT mmsi, strftime(ts, '%d/%m/%Y %H:%M:%S') AS timestamp_text, ts FROM positions"
        ),
        "valid_coordinates": _with(
            "SELECT * FROM positions WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"
        ),
        "exclude_ship_type": _with("SELECT * FROM positions WHERE ship_type <> 'SAR'"),
        "clean_positions": _with("SELECT * FROM clean"),
        "low_speed": _with("SELECT * FROM slow"),
        "rename_bins": _with("SELECT * FROM coarse"),
        "slow_positions": _with("SELECT * FROM slow_positions"),
        "stationary_positions": _with(f"SELECT {stationary_columns} FROM stationary"),
        "low_speed_counts": _with("SELECT * FROM counts"),
        "dwelling_vessels": _with("SELECT * FROM dwelling"),
        "vessel_total": _with("SELECT count(DISTINCT mmsi) AS vessels FROM stationary"),
        "vessel_distance": _with("SELECT mmsi, round(total_distance_km, 6) AS total_distance_km FROM distance"),
        "stationary_vessels": _with("SELECT mmsi, round(total_distance_km, 6) AS total_distance_km FROM near"),
        "stationary_vessel_days": _with(
            """SELECT mmsi, day, round(sum(segment_km), 6) AS total_distance_km FROM (
                SELECT mmsi, day, 2 * 6371 * asin(sqrt(least(1.0E0,
                    power(sin(radians(latitude - prev_lat) / 2), 2) + cos(radians(prev_lat)) * cos(radians(latitude))
                    * power(sin(radians(longitude - prev_lon) / 2), 2)))) AS segment_km
                FROM (SELECT *, CAST(ts AS DATE) AS day, lag(latitude) OVER w AS prev_lat, lag(longitude) OVER w AS prev_lon
                      FROM slow WINDOW w AS (PARTITION BY mmsi, CAST(ts AS DATE) ORDER BY ts, latitude, longitude))
                WHERE prev_lat IS NOT NULL)
            GROUP BY mmsi, day HAVING sum(segment_km) < 10.0"""
        ),
        "ship_type_histogram": _with(
            """SELECT ship_type, count(*) AS "count" FROM stationary GROUP BY ship_type
            ORDER BY count(*) DESC, ship_type"""
        ),
        "mover_exclusion": _with(
            f"""SELECT clean.*, fast_msgs FROM clean JOIN (
                SELECT mmsi, count(CASE WHEN sog >= 0.5 THEN 1 END) AS fast_msgs FROM clean GROUP BY mmsi) fast
            ON clean.mmsi = fast.mmsi WHERE fast_msgs <= {FAST_MESSAGES_KEPT}"""
        ),
        "previous_position": _with("SELECT * FROM steps"),
        "segment_distance": _with("SELECT * EXCLUDE (segment_km), round(segment_km, 6) AS segment_km FROM segments"),
        "stored_distance": _with("SELECT mmsi, round(total_distance_km, 6) AS total_distance_km FROM distance"),
        "history_distance": _with("SELECT mmsi, round(total_distance_km, 6) AS total_distance_km FROM distance"),
        "history_stationary_vessels": _with("SELECT mmsi, round(total_distance_km, 6) AS total_distance_km FROM near"),
        "cell_vessel_counts": _with("SELECT * FROM bins"),
        "fine_bins": _with(f"SELECT {stationary_columns}, lat_bin, lon_bin FROM binned"),
        "bin_vessel_counts": _with("SELECT * FROM bins"),
        "port_candidates": _with("SELECT * FROM candidates"),
        "candidate_total": _with("SELECT count(*) AS candidates FROM candidates"),
        "top_port_candidates": _with(
            "SELECT * FROM candidates ORDER BY vessel_count DESC, lat_bin, lon_bin LIMIT 5"
        ),
        "coarse_bins": _with("SELECT * FROM coarse_binned"),
        "coarse_ports": _with("SELECT * FROM coarse"),
        "top_coarse_ports": _with("SELECT * FROM coarse ORDER BY vessel_count DESC, lat_bin, lon_bin LIMIT 20"),
        "coarse_port_vessels": _with(
            """SELECT lat_bin_ports, lon_bin_ports, vessel_count, distinct_vessels
            FROM (SELECT lat_bin_ports, lon_bin_ports, CAST(sum(vessel_count) AS BIGINT) AS vessel_count
                  FROM coarse_binned GROUP BY lat_bin_ports, lon_bin_ports)
            JOIN (SELECT lat_bin_ports, lon_bin_ports, count(DISTINCT mmsi) AS distinct_vessels
                  FROM coarse_binned JOIN binned USING (lat_bin, lon_bin) GROUP BY lat_bin_ports, lon_bin_ports)
            USING (lat_bin_ports, lon_bin_ports)"""
        ),
        "dbscan_labels": _with("SELECT * FROM labelled", dense),
        "dbscan_core_border_noise": _with("SELECT * FROM labelled", sparse),
        "dbscan_globe": _with("SELECT * FROM labelled", (GLOBE_EPS_KM, 1), NEAR_BY_KM),
        "dbscan_globe_roles": _with("SELECT * FROM labelled", (GLOBE_SPARSE_KM, SPARSE_MIN_SAMPLES), NEAR_BY_KM),
        "dbscan_ports": _with(
            "SELECT cluster, round(lat_bin, 6) AS lat_bin, round(lon_bin, 6) AS lon_bin, vessel_count FROM dbscan",
            dense,
        ),
        "top_dbscan_ports": _with(
            """SELECT cluster, round(lat_bin, 6) AS lat_bin, round(lon_bin, 6) AS lon_bin, vessel_count
            FROM dbscan ORDER BY vessel_count DESC, cluster LIMIT 5""",
            dense,
        ),
        "dbscan_port_vessels": _with(
            """SELECT cluster, vessel_count, distinct_vessels FROM dbscan JOIN (
                SELECT cluster, count(DISTINCT mmsi) AS distinct_vessels
                FROM labelled JOIN binned USING (lat_bin, lon_bin) GROUP BY cluster) USING (cluster)""",
            dense,
        ),
        "feature_vectors": _with("SELECT mmsi, ts, longitude AS feature_0, latitude AS feature_1 FROM stationary"),
        "kmeans_fit": _with(f"SELECT 7 AS k, {fit_facts} FROM stationary"),
        "kmeans_reports": _with(
            f"SELECT k, {fit_facts} FROM stationary CROSS JOIN (VALUES (7), (15), (20)) AS t(k) GROUP BY k"
        ),
        "kmeans_message_fit": _with(f"SELECT 3 AS k, {three_cost} AS wssse"),
        "kmeans_centers": _with(
            """SELECT 3 AS k, prediction AS cluster_id, round(avg(longitude), 6) AS longitude,
            round(avg(latitude), 6) AS latitude FROM assigned GROUP BY prediction"""
        ),
        "kmeans_assign": _with(f"SELECT {stationary_columns}, prediction FROM assigned"),
        "kmeans_cluster_counts": _with(
            "SELECT prediction, count(DISTINCT mmsi) AS ship_count FROM assigned GROUP BY prediction"
        ),
        "kmeans_summary": _with(
            """SELECT cluster_id, vessel_count, round(lat_bin, 6) AS lat_bin, round(lon_bin, 6) AS lon_bin
            FROM summary"""
        ),
        "kmeans_map_features": _with(
            """SELECT round(lat_bin, 6) AS lat, round(lon_bin, 6) AS lon,
            CAST(least(vessel_count, 20) AS INTEGER) AS radius,
            'Vessels: ' || vessel_count || ', Cluster: ' || cluster_id AS popup FROM summary"""
        ),
        "elbow_costs": _with(
            f"""SELECT k, (SELECT count(*) FROM stationary) AS messages, TRUE AS agrees,
            CASE WHEN k = 3 THEN {three_cost} END AS wssse_of_three
            FROM (VALUES (2), (3), (4), (5), (6), (7), (8), (9)) AS t(k)"""
        ),
        "elbow_choice": _with(
            f"""SELECT k, round(wssse, 6) AS wssse, round(gap, 6) AS below_chord,
                row_number() OVER (ORDER BY gap DESC, k) = 1 AS chosen
            FROM (SELECT k, wssse, round(1 - (k - 1) / {len(ELBOW_CENTERS) - 1}.0E0
                    - (wssse - min(wssse) OVER ()) / (max(wssse) OVER () - min(wssse) OVER ()), 12) AS gap
                FROM (SELECT k, sum(d2) AS wssse
                    FROM (SELECT k, m, min(power(longitude - lon, 2) + power(latitude - lat, 2)) AS d2
                        FROM (SELECT row_number() OVER () AS m, longitude, latitude FROM stationary)
                            CROSS JOIN (VALUES {_elbow_values()}) AS c(id, lon, lat)
                            JOIN (SELECT unnest(range(1, {len(ELBOW_CENTERS) + 1}))::INTEGER AS k) ON id <= k
                        GROUP BY k, m)
                    GROUP BY k))"""
        ),
        "kmeans_whole_centers": _with(
            f"""SELECT 3 AS k, prediction AS cluster_id, round(avg(longitude), 6) AS longitude,
            round(avg(latitude), 6) AS latitude, count(*) AS messages, {three_cost} AS wssse
            FROM assigned GROUP BY prediction"""
        ),
        "kmeans_three_summary": _with(
            "SELECT vessel_count, round(lat_bin, 6) AS lat_bin, round(lon_bin, 6) AS lon_bin FROM summary"
        ),
        "kmeans_three_cost": _with(
            """SELECT 3 AS k, round(sum(spread), 3) AS wssse FROM (
                SELECT (var_pop(latitude) + var_pop(longitude)) * count(*) AS spread FROM assigned GROUP BY prediction)"""
        ),
        "assign_to_centers": _with(
            f"SELECT {stationary_columns}, prediction, round(d2, 6) AS d2 FROM assigned"
        ),
        "wssse_for_centers": _with(
            """SELECT prediction AS cluster_id, count(*) AS messages, round(sum(d2), 6) AS wssse
            FROM assigned GROUP BY prediction"""
        ),
        "given_centers_cluster_counts": _with(
            "SELECT prediction, count(DISTINCT mmsi) AS ship_count FROM assigned GROUP BY prediction"
        ),
        "given_centers_summary": _with(
            """SELECT cluster_id, vessel_count, round(lat_bin, 6) AS lat_bin, round(lon_bin, 6) AS lon_bin
            FROM summary"""
        ),
        "given_centers_map_features": _with(
            """SELECT round(lat_bin, 6) AS lat, round(lon_bin, 6) AS lon,
            CAST(least(vessel_count, 20) AS INTEGER) AS radius,
            'Vessels: ' || vessel_count || ', Cluster: ' || cluster_id AS popup FROM summary"""
        ),
        "port_size_range": _with(
            " UNION ALL ".join(
                _span(table, method)
                for table, method in (
                    ("candidates", "fine grid"),
                    ("coarse", "coarse grid"),
                    ("dbscan", "dbscan"),
                    ("summary", "given centers"),
                )
            ),
            dense,
        ),
        "map_center": _with(
            "SELECT round(avg(lat_bin), 6) AS center_lat, round(avg(lon_bin), 6) AS center_lon FROM candidates"
        ),
        "map_features": _with(bubbles),
        "map_features_written": _with(bubbles),
        "geojson_features": _with(
            """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon_bin || ',' || lat_bin
            || ']},"properties":{"radius":' || least(vessel_count, 20) || ',"popup":"Vessels: ' || vessel_count || '"}}'
            AS feature FROM candidates"""
        ),
    }
