"""SQL conformance on the fixtures (X1-X8): what the reference reaches through arbitrary SQL.

Each query runs through ``spark.sql`` on the registered views; the oracle is the same
statement in DuckDB's dialect where the two differ.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sketch
from tessera.operators.asof import asof_join
from tessera.plans.registry import query
from tessera.session import materialize

SQL: dict[str, tuple[str, str | None]] = {
    # assets are one row for each country, so no incident meets many of them
    "x1_inner_join": ("""
SELECT i.incident_id, a.assets, a.inactive FROM incidents i JOIN (SELECT country, count(*) AS assets,
  count(*) FILTER (WHERE status = 'Inactive') AS inactive FROM assets GROUP BY country) a ON i.country_txt = a.country""", None),
    "x1_left_join": ("""
SELECT n.n_name, count(a.name) AS assets FROM nation n LEFT JOIN assets a ON a.country = n.n_name
AND a.type = 'Port' GROUP BY n.n_name""", None),
    "x1_full_join": ("""
SELECT coalesce(x.country_txt, y.country) AS country, x.iyear, x.incidents, y.assets FROM
(SELECT country_txt, iyear, count(*) AS incidents FROM incidents GROUP BY country_txt, iyear) x
FULL OUTER JOIN (SELECT country, count(*) AS assets FROM assets GROUP BY country) y
ON x.country_txt = y.country""", None),
    "x1_semi_join": ("""
SELECT incident_id FROM incidents i WHERE EXISTS (SELECT 1 FROM assets a WHERE a.country = i.country_txt)""", None),
    "x1_anti_join": ("""
SELECT incident_id FROM incidents i WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.country = i.country_txt AND a.type = 'Port')""", None),
    "x3_rollup": ("""
SELECT region_txt, attacktype1_txt, count(*) AS n, count(DISTINCT gname) AS groups,
  round(sum(nkill) FILTER (WHERE success = 1), 6) AS kill_success
FROM incidents GROUP BY ROLLUP (region_txt, attacktype1_txt)""", None),
    "x3_cube": ("""
SELECT region_txt, weaptype1_txt, count(*) AS n FROM incidents GROUP BY CUBE (region_txt, weaptype1_txt)""", None),
    "x3_grouping_sets": ("""
SELECT region_txt, iyear, count(*) AS n FROM incidents GROUP BY GROUPING SETS ((region_txt), (iyear), ())""", None),
    "x4_windows": ("""
SELECT country_txt, iyear, n,
  CAST(rank() OVER (PARTITION BY iyear ORDER BY n DESC, country_txt) AS BIGINT) AS rnk,
  lag(n) OVER (PARTITION BY country_txt ORDER BY iyear) AS prev_n,
  lead(n) OVER (PARTITION BY country_txt ORDER BY iyear) AS next_n,
  CAST(sum(n) OVER (PARTITION BY country_txt ORDER BY iyear ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS rows2,
  CAST(sum(n) OVER (PARTITION BY country_txt ORDER BY iyear RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS range3
FROM (SELECT country_txt, iyear, count(*) AS n FROM incidents GROUP BY country_txt, iyear) t""", None),
    "x5_set_operations": ("""
SELECT 'intersect' AS op, country FROM (SELECT country_txt AS country FROM incidents
  INTERSECT SELECT country FROM assets) a
UNION ALL SELECT 'except', country FROM (SELECT country_txt AS country FROM incidents
  EXCEPT SELECT country FROM assets) b
UNION ALL SELECT 'union', country FROM (SELECT country FROM assets
  UNION SELECT country_txt FROM incidents) c""", None),
    "x6_scalars": ("""
SELECT event_id, upper(event_type) AS et, length(event_type) AS len, substr(event_type, 1, 3) AS pre,
  CAST(get_json_object(props, '$.k') AS INT) AS k, CAST(EXTRACT(HOUR FROM ts) AS INT) AS hr,
  CAST(EXTRACT(DAY FROM ts) AS INT) AS dy, floor(value) AS fl, sqrt(abs(value)) AS sq,
  CAST(size(split(event_type, 'i')) AS INT) AS parts, concat(event_type, '#', CAST(user_id AS STRING)) AS tag
FROM events""", """
SELECT event_id, upper(event_type) AS et, length(event_type) AS len, substr(event_type, 1, 3) AS pre,
  CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(EXTRACT(HOUR FROM ts) AS INT) AS hr,
  CAST(EXTRACT(DAY FROM ts) AS INT) AS dy, CAST(floor(value) AS BIGINT) AS fl, sqrt(abs(value)) AS sq,
  CAST(len(string_split(event_type, 'i')) AS INT) AS parts, concat(event_type, '#', CAST(user_id AS VARCHAR)) AS tag
FROM events"""),
    "x7_top_k_per_group": ("""
SELECT region_txt, country_txt, n, rk FROM (SELECT region_txt, country_txt, n,
  CAST(row_number() OVER (PARTITION BY region_txt ORDER BY n DESC, country_txt) AS BIGINT) AS rk
  FROM (SELECT region_txt, country_txt, count(*) AS n FROM incidents GROUP BY region_txt, country_txt) t) u
WHERE rk <= 3""", None),
    "x8_subqueries": ("""
SELECT country_txt, count(*) AS above_avg,
  CAST(sum(CASE WHEN nkill > (SELECT avg(j.nkill) FROM incidents j WHERE j.country_txt = i.country_txt)
    THEN 1 ELSE 0 END) AS BIGINT) AS above_country_avg
FROM incidents i WHERE nkill > (SELECT avg(nkill) FROM incidents)
  AND EXISTS (SELECT 1 FROM assets a WHERE a.country = i.country_txt)
GROUP BY country_txt""", None),
}

for _name, (_spark_sql, _duck_sql) in SQL.items():
    def _mk(text):
        def build(spark):
            return spark.sql(text)
        return build
    query(_name, oracle=_duck_sql or _spark_sql)(_mk(_spark_sql))


@query("x2_asof_join", oracle="""
SELECT a.article_id, w.obs_id, w.temperature_c FROM live_articles a
ASOF LEFT JOIN weather_obs w ON a.source_country = w.country AND a.seendate > w.observed_at""")
def x2_asof_join(spark):
    """Latest weather observation strictly before each article, same country."""
    arts = spark.table("live_articles").select("article_id", "source_country", "seendate")
    obs = spark.table("weather_obs").withColumnRenamed("country", "source_country")
    out = asof_join(arts, obs, key="source_country", left_time="seendate", right_time="observed_at",
                    right_id="obs_id", right_cols=["temperature_c"])
    return out.select("article_id", "obs_id", "temperature_c")


@query("x7_approx_distinct")
def x7_approx_distinct(spark):
    """Approximate distinct counts (HyperLogLog++, 5 % relative error): rows-only check."""
    return spark.table("incidents").groupBy("region_txt").agg(
        F.approx_count_distinct("gname", 0.05).alias("approx_groups"),
        F.countDistinct("gname").alias("exact_groups"))


SPAN_ERROR = 0.08      # five standard errors of a sketch


@query("x7_sketch_spans", oracle="""
WITH y AS (SELECT DISTINCT iyear FROM incidents),
s AS (SELECT a.iyear AS from_, b.iyear AS to_ FROM y a JOIN y b ON a.iyear <= b.iyear)
SELECT region_txt, from_, to_, count(DISTINCT city) AS exact, TRUE AS within FROM incidents i
JOIN s ON i.iyear BETWEEN s.from_ AND s.to_ WHERE city IS NOT NULL GROUP BY region_txt, from_, to_""")
def x7_sketch_spans(spark):
    """Distinct cities per region over every span of years, from stored yearly sketches; exact counts beside them."""
    inc = spark.table("incidents").select("region_txt", "iyear", "city")
    years = inc.agg(F.collect_set("iyear").alias("y"))               # a row of all years
    spans = years.select("y", F.explode("y").alias("from_")).select("from_", F.explode("y").alias("to_")).filter("from_ <= to_")
    spans = materialize(spans, "spans")
    store = materialize(sketch.stored_sketches(inc, ["region_txt"], "iyear", "city"), "sketches")
    united = sketch.distinct_over(store, spans, ["region_txt"], "iyear")
    days = spans.withColumn("iyear", F.explode(F.sequence("from_", "to_")))
    exact = (inc.filter("city IS NOT NULL").distinct().join(days, "iyear").groupBy("region_txt", "from_", "to_")
             .agg(F.countDistinct("city").alias("exact")))
    within = F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * SPAN_ERROR
    return united.join(exact, ["region_txt", "from_", "to_"]).select("region_txt", "from_", "to_", "exact", within.alias("within"))
