"""Spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.expr import haversine_km, haversine_sql, round_even
from tessera.operators import cluster, geo
from tessera.operators.prep import scored_incidents
from tessera.plans.registry import query
from tessera.plans.sqlparts import SCORED_INCIDENTS_CTE

HOT_EPS, HOT_MIN = 100.0, 15
WIN_YEARS, WIN_EPS, WIN_MIN = 5, 150.0, 10


def dbscan_sql(src: str, eps: float, min_samples: int, keys: list[str], name: str) -> str:
    """DuckDB DBSCAN oracle: all neighbour pairs, weighted core test, a recursive walk
    from every core point to larger core ids (the smallest id reaches its whole
    component), min root per node, dense rank; border = min adjacent cluster."""
    kc = "".join(f"{k}, " for k in keys)
    kj = "".join(f" AND a.{k} = b.{k}" for k in keys)
    ks = "".join(f"s.{k}, " for k in keys)
    kp = "".join(f"p.{k}, " for k in keys)
    kpart = ("PARTITION BY " + ", ".join(keys)) if keys else ""
    hav = haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")
    kjs = "".join(f" AND s.{k} = t.{k}" for k in keys)
    return f"""
{name}_pts AS (SELECT {kc}latitude AS lat, longitude AS lon, count(*) AS w, min(incident_id) AS pid
  FROM {src} WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY ALL),
{name}_pairs AS (SELECT a.pid AS a, b.pid AS b, b.w AS bw FROM {name}_pts a JOIN {name}_pts b
  ON {hav} <= {eps}{kj}),
{name}_core AS (SELECT a AS pid FROM {name}_pairs GROUP BY a HAVING sum(bw) >= {min_samples}),
{name}_cedge AS (SELECT p.a, p.b FROM {name}_pairs p
  WHERE p.a IN (SELECT pid FROM {name}_core) AND p.b IN (SELECT pid FROM {name}_core)),
{name}_r(root, node) AS (SELECT pid, pid FROM {name}_core
  UNION SELECT r.root, e.b FROM {name}_r r JOIN {name}_cedge e ON e.a = r.node WHERE e.b > r.root),
{name}_comp AS (SELECT {kp}c.node AS pid, c.label FROM
  (SELECT node, min(root) AS label FROM {name}_r GROUP BY node) c JOIN {name}_pts p ON p.pid = c.node),
{name}_num AS (SELECT label, CAST(dense_rank() OVER ({kpart} ORDER BY label) - 1 AS INT) AS cluster
  FROM (SELECT DISTINCT {kc}label FROM {name}_comp) d),
{name}_cc AS (SELECT c.pid, n.cluster FROM {name}_comp c JOIN {name}_num n ON n.label = c.label),
{name}_border AS (SELECT p.a AS pid, min(cc.cluster) AS cluster FROM {name}_pairs p
  JOIN {name}_cc cc ON cc.pid = p.b WHERE p.a NOT IN (SELECT pid FROM {name}_core) GROUP BY p.a),
{name}_ptc AS (SELECT {kp}p.lat, p.lon, coalesce(cc.cluster, b.cluster, -1) AS cluster
  FROM {name}_pts p LEFT JOIN {name}_cc cc ON cc.pid = p.pid LEFT JOIN {name}_border b ON b.pid = p.pid),
{name} AS (SELECT s.incident_id, {ks}t.cluster FROM {src} s JOIN {name}_ptc t
  ON s.latitude = t.lat AND s.longitude = t.lon{kjs})"""


HOT_CTES = f"""WITH RECURSIVE {SCORED_INCIDENTS_CTE},
{dbscan_sql('scored', HOT_EPS, HOT_MIN, [], 'hot')},
members AS (SELECT s.*, h.cluster FROM scored s JOIN hot h USING (incident_id) WHERE h.cluster <> -1),
modes AS (SELECT cluster, country_txt, row_number() OVER (PARTITION BY cluster
  ORDER BY count(*) DESC, country_txt) AS rn FROM members GROUP BY cluster, country_txt),
summary AS (SELECT m.cluster, count(*) AS incidents, sum(tsi) AS total_tsi, avg(tsi) AS avg_tsi,
  avg(latitude) AS centroid_lat, avg(longitude) AS centroid_lon, min(md.country_txt) AS countries
  FROM members m JOIN modes md ON md.cluster = m.cluster AND md.rn = 1 GROUP BY m.cluster),
ranked AS (SELECT *, row_number() OVER (ORDER BY total_tsi DESC, cluster) AS rank FROM summary)"""


def hotspots(spark):
    """Scored incidents, their cluster labels, and the G3 summary (unrounded)."""
    inc = scored_incidents(spark)
    lab = cluster.dbscan(inc, HOT_EPS, HOT_MIN)
    clustered = inc.join(lab, "incident_id")
    return inc, clustered, cluster.hotspot_summary(clustered)


@query("g1_haversine_to_centroid", oracle=f"""
WITH {SCORED_INCIDENTS_CTE},
cent AS (SELECT country_txt, median(latitude) AS clat, median(longitude) AS clon FROM scored
  WHERE country_txt IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY country_txt)
SELECT s.incident_id, round_even({haversine_sql('s.latitude', 's.longitude', 'c.clat', 'c.clon')}, 6) AS dist_km
FROM scored s JOIN cent c USING (country_txt) WHERE s.latitude IS NOT NULL""")
def g1_haversine_to_centroid(spark):
    inc = scored_incidents(spark)
    cent = geo.country_centroids(inc)
    j = inc.filter(F.col("latitude").isNotNull()).join(cent, "country_txt")
    return j.select("incident_id", round_even(haversine_km("latitude", "longitude", "centroid_lat",
                                                           "centroid_lon"), 6).alias("dist_km"))


@query("g2_hotspot_labels", oracle=HOT_CTES + "\nSELECT incident_id, cluster FROM hot")
def g2_hotspot_labels(spark):
    return cluster.dbscan(scored_incidents(spark), HOT_EPS, HOT_MIN)


@query("g3_hotspot_summary", bench=True, oracle=HOT_CTES + """
SELECT cluster, incidents, round_even(total_tsi, 6) AS total_tsi, round_even(avg_tsi, 6) AS avg_tsi,
  round_even(centroid_lat, 6) AS centroid_lat, round_even(centroid_lon, 6) AS centroid_lon,
  countries, rank FROM ranked""")
def g3_hotspot_summary(spark):
    return cluster.round_summary(hotspots(spark)[2])


WIN_CTES = f"""WITH RECURSIVE {SCORED_INCIDENTS_CTE},
wpts AS (SELECT *, CAST((SELECT min(iyear) FROM scored WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
    + floor((iyear - (SELECT min(iyear) FROM scored WHERE latitude IS NOT NULL AND longitude IS NOT NULL))
    / {WIN_YEARS}) * {WIN_YEARS} AS INT) AS window_start
  FROM scored WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND iyear IS NOT NULL),
{dbscan_sql('wpts', WIN_EPS, WIN_MIN, ['window_start'], 'win')},
cents AS (SELECT w.window_start, l.cluster, avg(w.latitude) AS centroid_lat, avg(w.longitude) AS centroid_lon,
  count(*) AS incidents,
  CAST(least(w.window_start + {WIN_YEARS - 1}, (SELECT max(iyear) FROM wpts)) AS INT) AS window_end
  FROM wpts w JOIN win l ON l.incident_id = w.incident_id AND l.window_start = w.window_start
  WHERE l.cluster >= 0 GROUP BY w.window_start, l.cluster),
widx AS (SELECT window_start, dense_rank() OVER (ORDER BY window_start) AS w_idx
  FROM (SELECT DISTINCT window_start FROM cents) d),
cw AS (SELECT c.*, i.w_idx FROM cents c JOIN widx i USING (window_start)),
links AS (SELECT a.*, b.cluster AS r_cluster, b.centroid_lat AS r_lat, b.centroid_lon AS r_lon,
    b.incidents AS r_incidents, b.window_start AS r_window_start, b.window_end AS r_window_end,
    {haversine_sql('a.centroid_lat', 'a.centroid_lon', 'b.centroid_lat', 'b.centroid_lon')} AS dist_km
  FROM cw a JOIN cw b ON b.w_idx = a.w_idx + 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start, cluster
  ORDER BY dist_km, r_cluster) AS rn FROM links WHERE dist_km < 500.0) t WHERE rn = 1),
mig AS (SELECT centroid_lat AS from_lat, centroid_lon AS from_lon, r_lat AS to_lat, r_lon AS to_lon,
  round_even(dist_km, 1) AS drift_km, incidents AS from_incidents, r_incidents AS to_incidents,
  concat(window_start, '-', window_end) AS window_from, concat(r_window_start, '-', r_window_end) AS window_to,
  window_start AS window_start_from, cluster AS cluster_from, r_cluster AS cluster_to FROM best)"""


def _windows(spark):
    return cluster.window_centroids(scored_incidents(spark), WIN_YEARS, WIN_EPS, WIN_MIN)


@query("g4_window_centroids", oracle=WIN_CTES + """
SELECT window_start, window_end, cluster, round_even(centroid_lat, 6) AS centroid_lat,
  round_even(centroid_lon, 6) AS centroid_lon, incidents FROM cents""")
def g4_window_centroids(spark):
    c = _windows(spark)
    return c.select("window_start", "window_end", "cluster", round_even("centroid_lat", 6).alias("centroid_lat"),
                    round_even("centroid_lon", 6).alias("centroid_lon"), "incidents")


_MIG_OUT = """round_even(from_lat, 6) AS from_lat, round_even(from_lon, 6) AS from_lon,
  round_even(to_lat, 6) AS to_lat, round_even(to_lon, 6) AS to_lon"""


@query("g5_migration_vectors", oracle=WIN_CTES + f"""
SELECT {_MIG_OUT}, drift_km, from_incidents, to_incidents, window_from, window_to,
  window_start_from, cluster_from, cluster_to FROM mig""")
def g5_migration_vectors(spark):
    m = cluster.migration_vectors(_windows(spark))
    return m.withColumns({c: round_even(c, 6) for c in ["from_lat", "from_lon", "to_lat", "to_lon"]})


@query("g6_extrapolated_positions", oracle=WIN_CTES + f"""
, pred AS (SELECT to_lat AS from_lat, to_lon AS from_lon,
  greatest(-85.0, least(85.0, to_lat + (to_lat - from_lat))) AS to_lat,
  greatest(-180.0, least(180.0, to_lon + (to_lon - from_lon))) AS to_lon,
  drift_km, window_to AS window_from, 'Predicted' AS window_to, 'extrapolation' AS source,
  window_start_from, cluster_from FROM mig)
SELECT {_MIG_OUT}, drift_km, window_from, window_to, source, window_start_from, cluster_from FROM pred""")
def g6_extrapolated_positions(spark):
    p = cluster.extrapolate(cluster.migration_vectors(_windows(spark)))
    return p.withColumns({c: round_even(c, 6) for c in ["from_lat", "from_lon", "to_lat", "to_lon"]})


@query("g7_grid_density", oracle=f"""
WITH {SCORED_INCIDENTS_CTE}
SELECT CAST(floor(latitude / 1.0) AS BIGINT) AS cell_lat, CAST(floor(longitude / 1.0) AS BIGINT) AS cell_lon,
  count(*) AS incidents, round_even(sum(tsi), 6) AS total_tsi,
  (CAST(floor(latitude / 1.0) AS BIGINT) + 0.5) * 1.0 AS center_lat,
  (CAST(floor(longitude / 1.0) AS BIGINT) + 0.5) * 1.0 AS center_lon
FROM scored WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2""")
def g7_grid_density(spark):
    return geo.grid_density(scored_incidents(spark), 1.0)


@query("g7_hex_density", oracle=f"""
WITH {SCORED_INCIDENTS_CTE},
c AS (SELECT tsi, longitude * (sqrt(3.0) / 3) - latitude / 3 AS q, latitude * (2.0 / 3) AS r FROM scored
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
n AS (SELECT *, floor(q + 0.5) AS nq, floor(r + 0.5) AS nr, floor(-q - r + 0.5) AS ns, abs(floor(q + 0.5) - q) AS dq,
  abs(floor(r + 0.5) - r) AS dr, abs(floor(-q - r + 0.5) + q + r) AS ds FROM c),
h AS (SELECT tsi, CAST(CASE WHEN dq > dr AND dq > ds THEN -nr - ns ELSE nq END AS BIGINT) AS hex_q,
  CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -nq - ns ELSE nr END AS BIGINT) AS hex_r FROM n)
SELECT hex_q, hex_r, count(*) AS incidents, round_even(sum(tsi), 6) AS total_tsi, round_even(hex_r * 1.5, 6) AS center_lat,
  round_even((hex_q + hex_r / 2) * sqrt(3.0), 6) AS center_lon FROM h GROUP BY hex_q, hex_r""")
def g7_hex_density(spark):
    return geo.hex_density(scored_incidents(spark), 1.0)


@query("g8_peak_cell", oracle=f"""
WITH {SCORED_INCIDENTS_CTE},
c AS (SELECT country_txt, round_even(latitude * 10, 0) AS a, round_even(longitude * 10, 0) AS b, count(*) AS n
  FROM scored WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2, 3)
SELECT country_txt, max(n) AS peak_cell_incidents FROM c GROUP BY country_txt""")
def g8_peak_cell(spark):
    return geo.peak_cell(scored_incidents(spark))


@query("g9_country_centroids", oracle=f"""
WITH {SCORED_INCIDENTS_CTE}
SELECT country_txt, median(latitude) AS centroid_lat, median(longitude) AS centroid_lon FROM scored
WHERE country_txt IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY country_txt""")
def g9_country_centroids(spark):
    return geo.country_centroids(scored_incidents(spark))


@query("g10_radius_summary", oracle=f"""
WITH {SCORED_INCIDENTS_CTE},
p AS (SELECT a.name, s.nkill + s.nwound AS cas, s.attacktype1_txt AS atk FROM assets a JOIN scored s
  ON {haversine_sql('a.lat', 'a.lon', 's.latitude', 's.longitude')} <= 100.0
  WHERE s.latitude IS NOT NULL AND s.longitude IS NOT NULL),
m AS (SELECT name, atk, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, atk) AS rn
  FROM p GROUP BY name, atk),
g AS (SELECT name, count(*) AS incidents, round_even(sum(cas), 6) AS casualties FROM p GROUP BY name)
SELECT a.name, coalesce(g.incidents, 0) AS incidents, coalesce(g.casualties, 0.0) AS casualties,
  m.atk AS dominant_attack FROM assets a LEFT JOIN g USING (name) LEFT JOIN m ON m.name = a.name AND m.rn = 1""")
def g10_radius_summary(spark):
    return geo.radius_summary(spark.table("assets"), scored_incidents(spark), 100.0)


@query("g11_asset_exposure", oracle=HOT_CTES + f"""
, ni AS (SELECT a.name, count(*) AS n FROM assets a JOIN scored s
  ON {haversine_sql('a.lat', 'a.lon', 's.latitude', 's.longitude')} <= 150.0
  WHERE s.latitude IS NOT NULL GROUP BY a.name),
hp AS (SELECT a.name, r.cluster, {haversine_sql('a.lat', 'a.lon', 'r.centroid_lat', 'r.centroid_lon')} AS d
  FROM assets a JOIN ranked r ON {haversine_sql('a.lat', 'a.lon', 'r.centroid_lat', 'r.centroid_lon')} <= 150.0),
hn AS (SELECT name, count(*) AS hotspots_within, arg_min(cluster, (d, cluster)) AS nearest_hotspot,
  round_even(min(d), 6) AS nearest_km FROM hp GROUP BY name)
SELECT a.name, a.type, a.country, a.status, coalesce(ni.n, 0) AS incidents_within,
  coalesce(hn.hotspots_within, 0) AS hotspots_within, hn.nearest_hotspot, hn.nearest_km
FROM assets a LEFT JOIN ni USING (name) LEFT JOIN hn USING (name)""")
def g11_asset_exposure(spark):
    inc, _, summary = hotspots(spark)
    return geo.asset_exposure(spark.table("assets"), inc, summary, 150.0)


@query("g12_severity_layer", oracle=f"""
WITH {SCORED_INCIDENTS_CTE}
SELECT iyear, country_txt, count(*) AS incidents, round_even(sum(tsi), 6) AS total_tsi,
  round_even(avg(latitude), 6) AS mean_lat, round_even(avg(longitude), 6) AS mean_lon
FROM scored GROUP BY iyear, country_txt""")
def g12_severity_layer(spark):
    """The layer for every year (the reference draws one selected year)."""
    return geo.severity_layer(scored_incidents(spark))


@query("g13_hotspot_extent", oracle=HOT_CTES + f"""
SELECT m.cluster, min(m.latitude) AS min_lat, max(m.latitude) AS max_lat, min(m.longitude) AS min_lon,
  max(m.longitude) AS max_lon,
  round_even(max({haversine_sql('m.latitude', 'm.longitude', 'r.centroid_lat', 'r.centroid_lon')}), 6) AS radius_km
FROM members m JOIN ranked r USING (cluster) GROUP BY m.cluster""")
def g13_hotspot_extent(spark):
    _, clustered, summary = hotspots(spark)
    return geo.hotspot_extent(clustered, summary)
