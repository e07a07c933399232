"""Projection of the driver tables into the incident data model (FIXTURES.md part 2).

Each block is plain SQL that runs unchanged in Spark and DuckDB.  Spark registers
them as temp views over the parquet tables; the DuckDB oracle puts them as CTEs in
front of every oracle query.
"""

from __future__ import annotations

# The projection SQL, as given in FIXTURES.md.
FIXTURE_SQL: dict[str, str] = {}

FIXTURE_SQL["incidents"] = """
SELECT o.o_orderkey AS incident_id,
  CAST(year(o.o_orderdate) AS INT) AS iyear,
  CAST(month(o.o_orderdate) AS INT) AS imonth,
  CAST(day(o.o_orderdate) AS INT) AS iday,
  n.n_name AS country_txt, r.r_name AS region_txt,
  concat(n.n_name, '/', c.c_custkey % 7) AS city,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Bombing/Explosion'
    WHEN '2-HIGH' THEN 'Armed Assault' WHEN '3-MEDIUM' THEN 'Assassination'
    WHEN '5-LOW' THEN 'Hostage Taking (Barricade Incident)' ELSE 'Unknown' END AS attacktype1_txt,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'Explosives' WHEN 1 THEN 'Firearms'
    WHEN 2 THEN 'Melee' ELSE 'Unknown' END AS weaptype1_txt,
  c.c_mktsegment AS targtype1_txt,
  CASE WHEN c.c_custkey % 5 = 0 THEN 'Unknown' ELSE concat('GROUP_', c.c_custkey % 40) END AS gname,
  CASE WHEN o.o_orderkey % 53 = 0 THEN NULL
    WHEN o.o_orderkey % 211 = 0 THEN CAST(0 AS DOUBLE)
    WHEN o.o_orderkey % 97 = 0 THEN CAST((o.o_orderkey * 31) % 12000 - 6000 AS DOUBLE) / CAST(100 AS DOUBLE)
    ELSE CAST(400 * n.n_nationkey - 5000 + 80 * (c.c_custkey % 7) + (o.o_orderkey * 7919) % 41 - 20 AS DOUBLE) / CAST(100 AS DOUBLE) END AS latitude,
  CASE WHEN o.o_orderkey % 53 = 0 THEN NULL
    WHEN o.o_orderkey % 211 = 0 THEN CAST(0 AS DOUBLE)
    WHEN o.o_orderkey % 97 = 0 THEN CAST((o.o_orderkey * 17) % 36000 - 18000 AS DOUBLE) / CAST(100 AS DOUBLE)
    ELSE CAST(1400 * n.n_nationkey - 17000 + (o.o_orderkey * 104729) % 41 - 20 AS DOUBLE) / CAST(100 AS DOUBLE) END AS longitude,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL WHEN o.o_orderkey % 307 = 0 THEN CAST(-2 AS DOUBLE)
    WHEN o.o_orderkey % 1009 = 0 THEN CAST(500 AS DOUBLE)
    ELSE CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 13 AS DOUBLE) END AS nkill,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL
    ELSE CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 37 AS DOUBLE) END AS nwound,
  CASE WHEN o.o_orderstatus <> 'P' THEN 1 ELSE 0 END AS success,
  CASE WHEN o.o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS suicide,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS claimed
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

FIXTURE_SQL["live_articles"] = """
SELECT e.event_id AS article_id, e.ts AS seendate,
  concat('Report ', CASE WHEN e.event_id % 3 = 0 THEN e.event_id % 300 ELSE e.event_id END, ': ',
    CASE WHEN e.event_id % 3 = 0 THEN 'Blast wounded many'
      WHEN e.event_type = 'error' THEN 'Missile strike, dozens killed'
      WHEN e.event_type = 'click' THEN 'Border clash and shelling'
      WHEN e.event_type = 'purchase' THEN 'Explosion killed several'
      WHEN e.event_type = 'signup' THEN 'Militant attack reported'
      ELSE 'Curfew announced' END,
    ' near ', n.n_name, ' today') AS title,
  CASE WHEN e.event_id % 4 = 0 THEN 'Unknown' ELSE n.n_name END AS source_country,
  concat('site', e.user_id % 20, '.example') AS domain,
  concat('http://site', e.user_id % 20, '.example/', CASE WHEN e.event_id % 3 = 0 THEN e.event_id % 300 ELSE e.event_id END) AS url,
  'English' AS language
FROM events e JOIN nation n ON CAST(e.event_id % 25 AS INT) = n.n_nationkey
"""

FIXTURE_SQL["assets"] = """
SELECT s.s_name AS name,
  CASE s.s_suppkey % 4 WHEN 0 THEN 'Airbase' WHEN 1 THEN 'Naval Base' WHEN 2 THEN 'Port' ELSE 'Radar Station' END AS type,
  CAST(400 * n.n_nationkey - 5000 + s.s_suppkey % 300 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
  CAST(1400 * n.n_nationkey - 17000 + s.s_suppkey % 200 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon,
  n.n_name AS country,
  CASE WHEN s.s_suppkey % 9 = 0 THEN 'Inactive' ELSE 'Active' END AS status
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
"""

FIXTURE_SQL["weather_obs"] = """
SELECT e.event_id AS obs_id, e.ts AS observed_at, n.n_name AS country,
  CAST(e.event_id % 90 - 30 AS DOUBLE) AS temperature_c,
  CAST(e.event_id % 23 AS DOUBLE) AS wind_speed_ms,
  CAST((e.event_id * 7) % 1100 AS DOUBLE) / CAST(100 AS DOUBLE) AS visibility_km,
  CAST((e.event_id * 13) % 150 AS DOUBLE) / CAST(10 AS DOUBLE) AS rain_mm
FROM events e JOIN nation n ON CAST(e.event_id % 25 AS INT) = n.n_nationkey
"""

FIXTURE_SQL["messages"] = """
SELECT conv_id, turn, role,
  concat(text, CASE (conv_id + turn) % 7 WHEN 0 THEN ' highest risk' WHEN 1 THEN ' Compare these'
    WHEN 2 THEN ' what is the latest' WHEN 3 THEN ' forecast please'
    WHEN 4 THEN ' any hotspot' WHEN 5 THEN ' help' ELSE '' END) AS content
FROM conversations
"""
