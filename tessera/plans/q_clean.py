"""Cleaning and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions.expr import round_even
from tessera.operators import clean
from tessera.plans.registry import query
from tessera.plans.sqlparts import flag01, nonneg

BUSINESS = ", ".join(R.REQUIRED_COLS)


def _canon(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ('nan', '', 'NaN') THEN NULL ELSE trim({c}) END"


@query("s3_typed_projection", oracle="""
SELECT incident_id, CAST(iyear AS INT) AS iyear, CAST(imonth AS INT) AS imonth,
  CAST(iday AS INT) AS iday, country_txt, region_txt, city, attacktype1_txt, weaptype1_txt,
  targtype1_txt, gname, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude,
  CAST(nkill AS DOUBLE) AS nkill, CAST(nwound AS DOUBLE) AS nwound,
  CAST(success AS INT) AS success, CAST(suicide AS INT) AS suicide
FROM incidents""")
def s3_typed_projection(spark):
    return clean.typed_projection(spark.table("incidents"))


@query("c1_numeric_coercion", oracle=f"""
SELECT incident_id, {nonneg('nkill')} AS nkill, {nonneg('nwound')} AS nwound,
  CAST({flag01('success')} AS INT) AS success, CAST({flag01('suicide')} AS INT) AS suicide
FROM incidents""")
def c1_numeric_coercion(spark):
    return clean.coerce_numeric(spark.table("incidents")).select(
        "incident_id", "nkill", "nwound", "success", "suicide")


@query("c2_year_range", oracle="""
SELECT incident_id, iyear FROM incidents WHERE iyear BETWEEN 2000 AND 2020""")
def c2_year_range(spark):
    return clean.year_range(spark.table("incidents")).select("incident_id", "iyear")


@query("c3_drop_unknown_target", oracle="""
SELECT incident_id, attacktype1_txt FROM incidents
WHERE trim(attacktype1_txt) IS NOT NULL AND trim(attacktype1_txt) NOT IN ('', 'nan', 'Unknown', 'unknown')""")
def c3_drop_unknown_target(spark):
    return clean.drop_unknown_target(spark.table("incidents")).select("incident_id", "attacktype1_txt")


@query("c4_canonical_text", oracle=f"""
SELECT incident_id, {', '.join(f'{_canon(c)} AS {c}' for c in R.TEXT_COLS)} FROM incidents""")
def c4_canonical_text(spark):
    return clean.canonical_text(spark.table("incidents")).select("incident_id", *R.TEXT_COLS)


@query("c5_label_merge", oracle=f"""
SELECT incident_id, CASE WHEN attacktype1_txt = '{R.BARRICADE}' THEN '{R.KIDNAPPING}'
  ELSE attacktype1_txt END AS attacktype1_txt FROM incidents""")
def c5_label_merge(spark):
    return clean.merge_labels(spark.table("incidents")).select("incident_id", "attacktype1_txt")


@query("c6_null_island", oracle="""
SELECT incident_id,
  CASE WHEN coalesce(abs(latitude) < 0.01 AND abs(longitude) < 0.01, false) THEN NULL ELSE latitude END AS latitude,
  CASE WHEN coalesce(abs(latitude) < 0.01 AND abs(longitude) < 0.01, false) THEN NULL ELSE longitude END AS longitude
FROM incidents""")
def c6_null_island(spark):
    return clean.null_island(spark.table("incidents")).select("incident_id", "latitude", "longitude")


@query("c7_dedupe", oracle=f"""
SELECT min(incident_id) AS incident_id, {BUSINESS} FROM incidents GROUP BY {BUSINESS}""")
def c7_dedupe(spark):
    return clean.dedupe_rows(spark.table("incidents").select("incident_id", *R.REQUIRED_COLS))


PREPARED_SQL = f"""
WITH c3 AS (
  SELECT incident_id, {BUSINESS} FROM incidents
  WHERE iyear BETWEEN 2000 AND 2020 AND trim(attacktype1_txt) IS NOT NULL
    AND trim(attacktype1_txt) NOT IN ('', 'nan', 'Unknown', 'unknown')),
c4 AS (
  SELECT incident_id, iyear, imonth, iday, latitude, longitude, success, suicide, nkill, nwound,
    {', '.join(f'{_canon(c)} AS {c}' for c in R.TEXT_COLS)} FROM c3),
c5 AS (
  SELECT incident_id, iyear, imonth, iday, latitude, longitude, country_txt, region_txt, city,
    CASE WHEN attacktype1_txt = '{R.BARRICADE}' THEN '{R.KIDNAPPING}' ELSE attacktype1_txt END AS attacktype1_txt,
    weaptype1_txt, targtype1_txt, gname,
    CAST({flag01('success')} AS INT) AS success, CAST({flag01('suicide')} AS INT) AS suicide,
    {nonneg('nkill')} AS nkill, {nonneg('nwound')} AS nwound FROM c4),
c6 AS (
  SELECT * REPLACE (
    CASE WHEN coalesce(abs(latitude) < 0.01 AND abs(longitude) < 0.01, false) THEN NULL ELSE latitude END AS latitude,
    CASE WHEN coalesce(abs(latitude) < 0.01 AND abs(longitude) < 0.01, false) THEN NULL ELSE longitude END AS longitude)
  FROM c5)
SELECT min(incident_id) AS incident_id, {BUSINESS} FROM c6 GROUP BY {BUSINESS}"""


@query("c8_prepare_chronological", oracle=PREPARED_SQL)
def c8_prepare_chronological(spark):
    return clean.prepare(spark.table("incidents"))


@query("c9_class_distribution", oracle="""
SELECT attacktype1_txt, n, n / sum(n) OVER () AS share,
  row_number() OVER (ORDER BY n DESC, attacktype1_txt) AS class_rank
FROM (SELECT attacktype1_txt, count(*) AS n FROM incidents GROUP BY attacktype1_txt) t""")
def c9_class_distribution(spark):
    return clean.class_distribution(spark.table("incidents"))


@query("c10_coverage_profile", oracle="""
SELECT count(*) AS rows, min(iyear) AS year_min, max(iyear) AS year_max,
  count(DISTINCT country_txt) AS countries, count(DISTINCT gname) AS groups,
  count(latitude) AS rows_with_coords FROM incidents""")
def c10_coverage_profile(spark):
    return clean.coverage_profile(spark.table("incidents"))


@query("c11_uniform_class_warning", oracle="""
WITH counts AS (SELECT attacktype1_txt, count(*) AS n FROM incidents GROUP BY attacktype1_txt),
s AS (SELECT count(*) AS classes, sum(n) AS rows, stddev_samp(n) / avg(n) AS cv FROM counts)
SELECT classes, CAST(rows AS BIGINT) AS rows, round_even(cv, 6) AS cv,
  classes > 3 AND cv < 0.15 AND rows < 5000 AS warn_train,
  cv < 0.20 AND rows < 5000 AS warn_prepare FROM s""")
def c11_uniform_class_warning(spark):
    return clean.uniform_class_warning(spark.table("incidents")).withColumn(
        "cv", round_even("cv", 6))


@query("c12_country_points", oracle="""
SELECT incident_id, country_txt, latitude, longitude, iyear FROM (SELECT incident_id, country_txt,
  latitude, longitude, iyear, row_number() OVER (PARTITION BY country_txt ORDER BY incident_id) AS rk
  FROM incidents) t WHERE rk <= 500""")
def c12_country_points(spark):
    """The first 500 points of every country (the reference asks for one country)."""
    return clean.country_points(spark.table("incidents"), None, 500).select(
        "incident_id", "country_txt", "latitude", "longitude", "iyear")


@query("c13_map_points", bench=True, oracle="""
SELECT incident_id, iyear, latitude, longitude, country_txt, nkill FROM incidents
WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def c13_map_points(spark):
    """Map points of every year (a year slider filters ``iyear``)."""
    return clean.map_points(spark.table("incidents"))


@query("c14_down_sample", oracle="""
SELECT incident_id, latitude, longitude, md5(CAST(incident_id AS VARCHAR)) AS sample_key
FROM incidents WHERE latitude IS NOT NULL AND longitude IS NOT NULL
ORDER BY sample_key, incident_id LIMIT 10000""")
def c14_down_sample(spark):
    return clean.down_sample(spark.table("incidents"), 10_000)
