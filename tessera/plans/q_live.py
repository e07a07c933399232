"""Live feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions.expr import normalize_country, normalize_country_sql, ordered_rules_sql
from tessera.operators import geo, live
from tessera.operators.prep import scored_incidents
from tessera.plans.registry import query
from tessera.plans.sqlparts import SCORED_INCIDENTS_CTE
from tessera.session import scratch_path

EVENT_SQL = ordered_rules_sql("lower(title)", R.EVENT_RULES, R.EVENT_DEFAULT)
SEV_SQL = ordered_rules_sql("lower(title)", R.SEVERITY_RULES, R.SEVERITY_DEFAULT)
POINTS_SQL = ("CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.SEVERITY_POINTS.items())
              + " ELSE 20 END")
AS_OF_SQL = f"TIMESTAMP '{live.AS_OF}'"


def _map_sql(pairs, key: str, default) -> str:
    d = f"'{default}'" if isinstance(default, str) else str(default)
    return "CASE " + " ".join(
        f"WHEN {key} = '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in pairs
    ) + f" ELSE {d} END"


# The enriched live feed in DuckDB: classify, dedupe (title, url), exact country match,
# else first whole-word country in the title (contains on space-padded text).
LIVE_CTES = f"""{SCORED_INCIDENTS_CTE},
art AS (SELECT article_id, source_country AS country, source_country AS location, {EVENT_SQL} AS event,
  title, seendate AS date, domain AS source, url, {SEV_SQL} AS severity, language FROM live_articles),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY title, url ORDER BY article_id) AS rn
  FROM art) t WHERE rn = 1),
cent AS (SELECT country_txt, median(latitude) AS clat, median(longitude) AS clon FROM scored
  WHERE country_txt IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY country_txt),
cand AS (SELECT country_txt, clat, clon, {normalize_country_sql('country_txt')} AS cand FROM cent
  WHERE {normalize_country_sql('country_txt')} <> ''),
ex AS (SELECT article_id, country_txt, clat, clon FROM (SELECT d.article_id, c.country_txt, c.clat, c.clon,
  row_number() OVER (PARTITION BY d.article_id ORDER BY c.country_txt) AS rn FROM dd d
  JOIN cand c ON {normalize_country_sql('d.country')} = c.cand) t WHERE rn = 1),
tm AS (SELECT article_id, country_txt, clat, clon FROM (SELECT d.article_id, c.country_txt, c.clat, c.clon,
  row_number() OVER (PARTITION BY d.article_id ORDER BY c.country_txt) AS rn FROM dd d
  JOIN cand c ON contains(' ' || {normalize_country_sql('d.title')} || ' ', ' ' || c.cand || ' ')
  WHERE d.article_id NOT IN (SELECT article_id FROM ex)) t WHERE rn = 1),
mm AS (SELECT * FROM ex UNION ALL SELECT * FROM tm),
livefeed AS (SELECT d.article_id, coalesce(mm.country_txt, d.country) AS country, d.location, d.event, d.title,
  d.date, d.source, d.url, d.severity, d.language, mm.clat AS latitude, mm.clon AS longitude
  FROM dd d LEFT JOIN mm USING (article_id))"""

_COUNTRY = "coalesce(nullif(trim(country), ''), 'Unknown')"
_ATTACK = _map_sql(R.EVENT_TO_ATTACK, "event", "Unknown")
LIVE_ROWS_SQL = f"""
SELECT article_id, substr(sha256(lower(trim(coalesce(trim(title), '')))), 1, 40) AS source_id,
  '{live.AS_OF.replace(' ', 'T')}+00:00' AS ingested_at,
  CAST(year(date) AS INT) AS iyear, CAST(month(date) AS INT) AS imonth, CAST(day(date) AS INT) AS iday,
  {_COUNTRY} AS country_txt, {_map_sql(R.COUNTRY_TO_REGION, _COUNTRY, 'Unknown')} AS region_txt,
  CASE WHEN coalesce(nullif(trim(location), ''), {_COUNTRY}) <> {_COUNTRY}
    THEN coalesce(nullif(trim(location), ''), {_COUNTRY}) END AS city,
  {_ATTACK} AS attacktype1_txt, {_map_sql(R.ATTACK_TO_WEAPON, f'({_ATTACK})', 'Unknown')} AS weaptype1_txt,
  'Unknown' AS targtype1_txt, 'Unknown Group' AS gname, latitude, longitude,
  CAST({_map_sql(R.SEVERITY_TO_NKILL, 'severity', 0)} AS INT) AS nkill,
  CAST({_map_sql(R.SEVERITY_TO_NWOUND, 'severity', 0)} AS INT) AS nwound,
  1 AS success, 0 AS suicide, 'GDELT' AS source_label, coalesce(trim(title), '') AS original_title, severity
FROM livefeed"""


def live_feed(spark):
    """Classified, deduplicated, country-enriched live events."""
    arts = live.dedupe_articles(live.articles_frame(spark.table("live_articles")))
    cent = geo.country_centroids(scored_incidents(spark))
    return live.enrich_with_centroids(arts, cent)


@query("l1_event_type", oracle=f"SELECT article_id, {EVENT_SQL} AS event FROM live_articles")
def l1_event_type(spark):
    a = spark.table("live_articles")
    return a.select("article_id", live.classify_event(F.col("title")).alias("event"))


@query("l2_severity_level", oracle=f"SELECT article_id, {SEV_SQL} AS severity FROM live_articles")
def l2_severity_level(spark):
    a = spark.table("live_articles")
    return a.select("article_id", live.classify_severity(F.col("title")).alias("severity"))


@query("l3_severity_points", oracle=f"""
SELECT article_id, severity, {POINTS_SQL} AS points FROM (SELECT article_id, {SEV_SQL} AS severity FROM live_articles) t""")
def l3_severity_points(spark):
    a = spark.table("live_articles").select("article_id", live.classify_severity(F.col("title")).alias("severity"))
    return a.withColumn("points", live.severity_points(F.col("severity")))


_RAW_DATE_SQL = """CASE WHEN article_id % 10 = 0 THEN 'not a date' WHEN article_id % 10 = 1 THEN NULL
  ELSE strftime(seendate, '%Y%m%dT%H%M%SZ') END"""


@query("l4_feed_date_parse", oracle=f"""
SELECT article_id, coalesce(try_strptime(raw, '%Y%m%dT%H%M%SZ'), TRY_CAST(raw AS TIMESTAMP), {AS_OF_SQL}) AS date
FROM (SELECT article_id, {_RAW_DATE_SQL} AS raw FROM live_articles) t""")
def l4_feed_date_parse(spark):
    a = spark.table("live_articles")
    raw = (F.when(F.col("article_id") % 10 == 0, F.lit("not a date"))
           .when(F.col("article_id") % 10 == 1, F.lit(None).cast("string"))
           .otherwise(F.date_format("seendate", live.GDELT_DATE_FORMAT)))
    return a.select("article_id", live.parse_feed_date(raw).alias("date"))


@query("l5_article_dedupe", oracle=f"""WITH {LIVE_CTES}
SELECT article_id, title, url FROM dd""")
def l5_article_dedupe(spark):
    arts = live.dedupe_articles(live.articles_frame(spark.table("live_articles")))
    return arts.select("article_id", "title", "url")


@query("l6_country_normalise", oracle=f"""
SELECT article_id, {normalize_country_sql('source_country')} AS country_key,
  {normalize_country_sql('title')} AS title_key FROM live_articles""")
def l6_country_normalise(spark):
    a = spark.table("live_articles")
    return a.select("article_id", normalize_country("source_country").alias("country_key"),
                    normalize_country("title").alias("title_key"))


@query("l7_country_match", oracle=f"""WITH {LIVE_CTES}
SELECT article_id, country FROM livefeed""")
def l7_country_match(spark):
    return live_feed(spark).select("article_id", "country")


@query("l8_centroid_enrichment", oracle=f"""WITH {LIVE_CTES}
SELECT article_id, country, location, event, title, date, source, url, severity, language, latitude, longitude
FROM livefeed""")
def l8_centroid_enrichment(spark):
    return live_feed(spark)


_FB_CTES = f"""top AS (SELECT *, row_number() OVER (ORDER BY iyear DESC, imonth DESC, iday DESC, incident_id) - 1 AS pos
  FROM scored ORDER BY iyear DESC, imonth DESC, iday DESC, incident_id LIMIT 50),
fb AS (SELECT pos, coalesce(country_txt, 'Unknown') AS country, coalesce(city, 'Unknown') AS location,
  coalesce(attacktype1_txt, 'Security Event') AS event,
  'Historical Event: ' || coalesce(attacktype1_txt, 'Attack') || ' in ' || coalesce(city, 'Unknown') AS title,
  coalesce(try_cast(make_timestamp(iyear, imonth, iday, 0, 0, 0) AS TIMESTAMP),
           {AS_OF_SQL} - to_hours(CAST(pos AS BIGINT))) AS date,
  '{R.FALLBACK_SOURCE}' AS source, '{R.FALLBACK_URL}' AS url,
  CASE WHEN nkill > 10 THEN 'Critical' WHEN nkill > 0 THEN 'High' ELSE 'Medium' END AS severity,
  'English' AS language, latitude, longitude FROM top)"""
_FALLBACK_SQL = f"WITH {SCORED_INCIDENTS_CTE},\n{_FB_CTES}"


@query("l9_historical_fallback", oracle=_FALLBACK_SQL + "\nSELECT * FROM fb")
def l9_historical_fallback(spark):
    return live.historical_fallback(scored_incidents(spark), 50)


@query("l10_fallback_resolution", oracle=f"""WITH {LIVE_CTES},
{_FB_CTES},
u AS (SELECT country, location, event, title, date, source, url, severity, language, 0 AS priority FROM livefeed
  UNION ALL SELECT country, location, event, title, date, source, url, severity, language, 1 FROM fb)
SELECT country, location, event, title, date, source, url, severity, language FROM u
WHERE priority = (SELECT min(priority) FROM u)""")
def l10_fallback_resolution(spark):
    return live.resolve_feed(live_feed(spark), live.historical_fallback(scored_incidents(spark), 50))


@query("l11_stable_id", oracle="""
SELECT article_id, substr(sha256(lower(trim(title))), 1, 40) AS source_id FROM live_articles""")
def l11_stable_id(spark):
    from tessera.functions.expr import source_id
    return spark.table("live_articles").select("article_id", source_id(F.col("title")).alias("source_id"))


@query("l12_live_rows", oracle=f"WITH {LIVE_CTES}\n" + LIVE_ROWS_SQL)
def l12_live_rows(spark):
    return live.to_incident_rows(live_feed(spark))


@query("l13_ingest_delta", oracle=f"""WITH {LIVE_CTES},
rows AS ({LIVE_ROWS_SQL}),
stored AS (SELECT DISTINCT r.source_id FROM rows r JOIN live_articles a USING (article_id)
  WHERE a.seendate < TIMESTAMP '2024-01-16 00:00:00')
SELECT article_id, source_id, original_title FROM (SELECT *, row_number() OVER (PARTITION BY source_id
  ORDER BY article_id) AS rn FROM rows WHERE source_id NOT IN (SELECT source_id FROM stored)) t WHERE rn = 1""")
def l13_ingest_delta(spark):
    """Batch one (first half of the month) is stored; batch two (all) ingests only new ids."""
    rows = live.to_incident_rows(live_feed(spark))
    seen = spark.table("live_articles").select("article_id", "seendate")
    first = rows.join(seen, "article_id").filter(F.col("seendate") < F.lit("2024-01-16 00:00:00")
                                                 .cast("timestamp_ntz")).drop("seendate")
    path = scratch_path(spark, "live_events")
    live.new_rows(first, spark.createDataFrame([], "source_id string")).write.parquet(path)
    stored = spark.read.parquet(path)
    return live.new_rows(rows, stored).select("article_id", "source_id", "original_title")


@query("l15_intent_routing", oracle=f"""
SELECT conv_id, turn, {ordered_rules_sql('lower(content)', R.INTENT_RULES, R.INTENT_DEFAULT)} AS intent
FROM messages WHERE role = 'user'""")
def l15_intent_routing(spark):
    m = spark.table("messages").filter(F.col("role") == "user")
    return m.select("conv_id", "turn", live.route_intent(F.col("content")).alias("intent"))


@query("l16_history_window", oracle="""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role, content FROM
(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM messages) t WHERE back <= 3""")
def l16_history_window(spark):
    return live.history_window(spark.table("messages"), 3)
