"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.operators import clean, live
from tessera.plans.q_clean import PREPARED_SQL
from tessera.plans.q_live import LIVE_CTES, LIVE_ROWS_SQL, live_feed
from tessera.plans.registry import query
from tessera.session import materialize, scratch_path
from tessera.sources import files, store

INC_COLS = [f.name for f in files.INCIDENT_SCHEMA.fields]
HIST = ", ".join(store.HISTORY_COLS)


# A file as users have them: columns in another order among others, text with quotes, commas and newlines.
_WIDE_CITY_SQL = "concat(city, ', \"', iyear, '\"', chr(10), 'east')"


def _write_wide(spark, path):
    city = F.concat("city", F.lit(', "'), F.col("iyear").cast("string"), F.lit('"\neast'))
    inc = spark.table("incidents").select(*INC_COLS).withColumn("city", city)
    other = {"eventid_note": F.concat(F.lit("note, "), F.col("incident_id").cast("string")), "extended": F.lit("0"),
             "summary": F.concat(F.lit('said "'), F.col("gname"), F.lit('",\nthen left'))}
    order = sorted(INC_COLS[::2]) + ["summary"] + sorted(INC_COLS[1::2], reverse=True)
    files.write_csv(inc.withColumns(other).select("eventid_note", *order, "extended"), path)


@query("s1_csv_scan", oracle=f"SELECT {', '.join(INC_COLS)} FROM incidents".replace("city", f"{_WIDE_CITY_SQL} AS city"))
def s1_csv_scan(spark):
    """A wide CSV read by column name into the incident schema."""
    path = scratch_path(spark, "incidents-csv")
    _write_wide(spark, path)
    return files.read_incident_csv(spark, path)


# every tenth incident has a year in words, every tenth three fields too many
@query("s1_csv_problems", oracle="""
SELECT count(*) AS rows, count(*) FILTER (WHERE incident_id % 10 = 3) AS bad_rows, count(*) FILTER (WHERE incident_id % 10 = 7) AS wrong_iyear,
  0 AS wrong_imonth, 0 AS missing_columns FROM incidents""")
def s1_csv_problems(spark):
    """Rows that do not fit the header and values of the wrong type are counted, over all incidents."""
    path = scratch_path(spark, "broken-csv")
    text = spark.table("incidents").select(*[F.col(c).cast("string").alias(c) for c in INC_COLS])
    kind = F.col("incident_id").cast("long") % 10
    files.write_csv(text.filter(kind != 3).withColumn("iyear", F.when(kind == 7, "nineteen").otherwise(F.col("iyear"))), f"{path}/part=a")
    last = INC_COLS[-1]                                   # without quotes the last column's commas make more fields
    plain = text.filter(kind == 3).select(*[F.lit("1").alias(c) for c in INC_COLS[:-1]], F.lit("1,2,3,4").alias(last))
    plain.write.option("header", True).option("quote", "").csv(f"{path}/part=b")
    return files.csv_problems(spark, f"{path}/part=*").select("rows", "bad_rows", "wrong_iyear", "wrong_imonth", "missing_columns")


@query("s2_sql_over_dataset", oracle="""
SELECT country_txt, count(*) AS n, CAST(sum(CASE WHEN success = 1 THEN 1 ELSE 0 END) AS BIGINT) AS successes
FROM incidents GROUP BY country_txt""")
def s2_sql_over_dataset(spark):
    return files.query_data(spark, """
SELECT country_txt, count(*) AS n, CAST(sum(CASE WHEN success = 1 THEN 1 ELSE 0 END) AS BIGINT) AS successes
FROM incidents GROUP BY country_txt""")


@query("s4_raw_load_inferred", oracle="""
SELECT CAST(incident_id AS BIGINT) AS incident_id, CAST(iyear AS INT) AS iyear, country_txt,
  CAST(nkill AS DOUBLE) AS nkill, """ + f"{_WIDE_CITY_SQL} AS city FROM incidents")
def s4_raw_load_inferred(spark):
    """An unknown CSV read with type inference, then typed."""
    path = scratch_path(spark, "incidents-raw-csv")
    _write_wide(spark, path)
    raw = files.read_incident_csv(spark, path, schema=None)
    return raw.select(F.col("incident_id").cast("bigint"), F.col("iyear").cast("int"), "country_txt",
                      F.col("nkill").cast("double"), "city")


@query("s5_alias_rename", oracle=f"SELECT incident_id, {HIST} FROM incidents")
def s5_alias_rename(spark):
    """A frame with alias names (country, killed, ...) renamed back to the model's names."""
    inc = spark.table("incidents").select("incident_id", *store.HISTORY_COLS)
    aliased = inc.withColumnsRenamed({dst: src for src, dst in R.COL_ALIASES})
    return clean.validate_columns(clean.rename_aliases(aliased)).select("incident_id", *store.HISTORY_COLS)


@query("s6_required_columns", oracle="SELECT count(*) AS rows_checked FROM incidents")
def s6_required_columns(spark):
    checked = clean.validate_columns(spark.table("incidents"))
    return checked.agg(F.count(F.lit(1)).alias("rows_checked"))


@query("s7_prepared_csv_sink", oracle=PREPARED_SQL)
def s7_prepared_csv_sink(spark):
    """The cleaned table written as CSV and read back (rows as c8)."""
    path = scratch_path(spark, "prepared-csv")
    prepared = clean.prepare(spark.table("incidents"))
    files.write_csv(prepared, path)
    return files.read_incident_csv(spark, path, prepared.schema)


_S8_SQL = """
SELECT article_id, CASE WHEN article_id % 17 = 0 THEN 'Untitled event' ELSE title END AS title,
  source_country, domain_fb AS domain, url, language,
  CAST(strptime(strftime(seendate, '%Y%m%dT%H%M%SZ'), '%Y%m%dT%H%M%SZ') AS TIMESTAMP) AS seendate
FROM (SELECT *, CASE WHEN article_id % 5 <> 0 THEN domain WHEN article_id % 10 <> 0 THEN 'web'
  ELSE 'GDELT' END AS domain_fb FROM live_articles) t"""


@query("s8_article_json", oracle=_S8_SQL)
def s8_article_json(spark):
    path = scratch_path(spark, "article-payloads")
    files.write_article_payloads(spark.table("live_articles"), path)
    return files.articles_from_payloads(spark, path).select(
        "article_id", "title", "source_country", "domain", "url", "language", "seendate")


@query("s9_asset_json", oracle="SELECT name, type, lat, lon, country, status FROM assets")
def s9_asset_json(spark):
    path = scratch_path(spark, "assets-json")
    spark.table("assets").write.mode("overwrite").json(path)
    return files.read_assets(spark, path)


# the rows that a store holds after an ingest of the whole feed: one of each id, the first article
STORED_SQL = f"""WITH {LIVE_CTES},
lrows AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY article_id) AS rn
  FROM ({LIVE_ROWS_SQL}) r) t WHERE rn = 1)"""


def _stored(spark, times: int = 1):
    """A fresh store with the whole feed ingested ``times`` times, each as a batch of its own."""
    root = scratch_path(spark, "store")
    store.ensure_tables(spark, root)
    rows = materialize(_live_rows(spark), "live-rows")
    for batch in range(times):
        store.ingest(spark, root, rows, str(batch))
    return root


@query("s10_store_tables", oracle=f"{STORED_SQL}\nSELECT {', '.join(store.LIVE_SCHEMA.names)} FROM lrows")
def s10_store_tables(spark):
    """The live table after creation (twice) and two ingests of the same feed."""
    root = _stored(spark, 2)
    store.ensure_tables(spark, root)
    return store.read_live(spark, root)


_COMBINED_SQL = f"""WITH {LIVE_CTES},
lrows AS ({LIVE_ROWS_SQL})
SELECT {HIST}, 'GTD' AS data_source FROM incidents
UNION ALL SELECT {HIST}, source_label AS data_source FROM lrows"""


def _live_rows(spark):
    return live.to_incident_rows(live_feed(spark))


@query("s11_combined_view", oracle=_COMBINED_SQL)
def s11_combined_view(spark):
    return store.combined(spark.table("incidents"), _live_rows(spark))


@query("s12_combined_fallback", oracle=f"SELECT {HIST}, 'GTD' AS data_source FROM incidents")
def s12_combined_fallback(spark):
    """No live table yet: the combined table is the history alone."""
    return store.load_combined(spark, spark.table("incidents"), scratch_path(spark, "missing-store"))


@query("s12_combined_load", oracle=f"""{STORED_SQL}
SELECT {HIST}, 'GTD' AS data_source FROM incidents
UNION ALL SELECT {HIST}, source_label AS data_source FROM lrows""")
def s12_combined_load(spark):
    """The combined table with a live table present."""
    return store.load_combined(spark, spark.table("incidents"), _stored(spark))


@query("s13_store_stats", oracle=f"""WITH {LIVE_CTES},
lrows AS ({LIVE_ROWS_SQL})
SELECT (SELECT count(*) FROM incidents) AS gtd_rows, count(*) AS live_rows,
  (SELECT count(*) FROM incidents) + count(*) AS total_rows,
  count(DISTINCT country_txt) AS live_countries, coalesce(max(ingested_at), 'Never') AS last_ingest FROM lrows""")
def s13_store_stats(spark):
    return store.store_stats(spark.table("incidents"), _live_rows(spark))


@query("s14_live_listing", oracle=f"""WITH {LIVE_CTES}
SELECT source_id, iyear, imonth, iday, country_txt, original_title FROM ({LIVE_ROWS_SQL}) t""")
def s14_live_listing(spark):
    return store.live_listing(_live_rows(spark)).select(
        "source_id", "iyear", "imonth", "iday", "country_txt", "original_title")


@query("s14_ingest_log", oracle=f"""WITH {LIVE_CTES},
lrows AS ({LIVE_ROWS_SQL}),
early AS (SELECT DISTINCT source_id FROM lrows JOIN live_articles a USING (article_id)
  WHERE a.seendate < TIMESTAMP '2024-01-16 00:00:00'),
late AS (SELECT DISTINCT source_id FROM lrows WHERE source_id NOT IN (SELECT source_id FROM early))
SELECT '{live.AS_OF}' AS run_at, 'GDELT' AS source, CAST(n AS INT) AS rows_added FROM (
  SELECT count(*) AS n FROM early UNION ALL SELECT count(*) FROM late) t WHERE n > 0""")
def s14_ingest_log(spark):
    """Two ingests into a fresh store (first half of the month, then all): the log, newest first."""
    root = scratch_path(spark, "store")
    rows = materialize(_live_rows(spark), "live-rows")
    seen = spark.table("live_articles").select("article_id", "seendate")
    first = rows.join(seen, "article_id").filter(
        F.col("seendate") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")).drop("seendate")
    store.ingest(spark, root, first, "1")
    store.ingest(spark, root, rows, "2")
    return store.log_listing(store.read_log(spark, root)).select("run_at", "source", "rows_added")
