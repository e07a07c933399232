"""Streaming queries (ST1-ST5): streams run to completion with AvailableNow; ST2-ST4
also run as batch queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.expr import normalize_country_sql
from tessera.operators import geo, risk
from tessera.operators.prep import scored_incidents
from tessera.plans.q_live import EVENT_SQL, LIVE_CTES, SEV_SQL, live_feed
from tessera.plans.q_risk import RISK_COLS_SQL, RISK_CTES
from tessera.plans.q_sources import STORED_SQL
from tessera.plans.registry import query
from tessera.session import materialize, scratch_path
from tessera.sources import store
from tessera.streaming import ingest as st

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _run_ingest(spark, with_risk: bool = False):
    src = scratch_path(spark, "article-files")
    st.write_article_files(spark.table("live_articles"), src)
    root = scratch_path(spark, "stream-store")
    risk_path = scratch_path(spark, "risk-snapshots") if with_risk else None
    hist = scored_incidents(spark)
    centroids = materialize(geo.country_centroids(hist), "centroids")  # read by every micro-batch
    st.ingest_stream(spark, src, root, centroids, scratch_path(spark, "ckpt-ingest"),
                     history=hist if with_risk else None, risk_path=risk_path)
    return root, risk_path


_TITLED = "source_id, original_title, severity, attacktype1_txt, country_txt"


@query("st1_stream_ingest", oracle=f"{STORED_SQL}\nSELECT {_TITLED} FROM lrows")
def st1_stream_ingest(spark):
    """Articles as a file stream -> idempotent store; what the title decides of the stored rows."""
    root, _ = _run_ingest(spark)
    return store.read_live(spark, root).select(*_TITLED.split(", "))


@query("st5_stream_risk_refresh", oracle=f"""{STORED_SQL.replace('lrows AS', 'stored AS')},
{RISK_CTES.removeprefix(LIVE_CTES + ',').replace('FROM livefeed GROUP BY 1', "FROM (SELECT country_txt AS country, severity FROM stored) s GROUP BY 1")}
SELECT {RISK_COLS_SQL} FROM rl""")
def st5_stream_risk_refresh(spark):
    """Risk snapshot per micro-batch (stream-static join); the last snapshot."""
    _, risk_path = _run_ingest(spark, with_risk=True)
    snaps = spark.read.parquet(risk_path)
    last = snaps.select(F.max("batch_id")).scalar()
    return risk.round_components(snaps.filter(F.col("batch_id") == last).drop("batch", "batch_id"))


_LB = ", ".join(
    f"CAST(sum(CASE WHEN date > {AS_OF} - INTERVAL {m} MINUTE AND date <= {AS_OF} THEN 1 ELSE 0 END) AS BIGINT) AS n_{n}"
    for n, m in st.LOOKBACKS)


@query("st2_lookback_counts", oracle=f"WITH {LIVE_CTES}\nSELECT country, {_LB} FROM livefeed GROUP BY country")
def st2_lookback_counts(spark):
    return st.lookback_counts(live_feed(spark))


@query("st3_tumbling_counts", oracle=f"""WITH {LIVE_CTES}
SELECT date_trunc('day', date) AS window_start, event, severity, count(*) AS n FROM livefeed
GROUP BY 1, 2, 3""")
def st3_tumbling_counts(spark):
    return st.tumbling_counts(live_feed(spark), "1 day")


@query("st4_surge_alerts", oracle=f"""WITH {LIVE_CTES}
SELECT time_bucket(INTERVAL 2 DAY, date, TIMESTAMP '1970-01-01') AS window_start, country, count(*) AS n
FROM livefeed GROUP BY 1, 2 HAVING count(*) >= 20""")
def st4_surge_alerts(spark):
    return st.surge_alerts(live_feed(spark), "2 days", 20)


def _landed(spark):
    src = scratch_path(spark, "article-files")
    st.write_article_files(spark.table("live_articles"), src)
    return src, scratch_path(spark, "counts"), scratch_path(spark, "ckpt-counts")


@query("st4_stream_surge", oracle=f"""
SELECT time_bucket(INTERVAL 2 DAY, seendate, TIMESTAMP '1970-01-01') AS window_start,
  {normalize_country_sql('source_country')} AS ckey, count(*) AS n
FROM live_articles GROUP BY 1, 2 HAVING count(*) >= 20""")
def st4_stream_surge(spark):
    """The same windows as a stream, per source country."""
    return st.surge_stream(spark, *_landed(spark))


@query("st3_stream_tumbling", oracle=f"""
SELECT date_trunc('day', seendate) AS window_start, {EVENT_SQL} AS event, {SEV_SQL} AS severity, count(*) AS n
FROM live_articles GROUP BY 1, 2, 3""")
def st3_stream_tumbling(spark):
    return st.tumbling_stream(spark, *_landed(spark))


@query("st2_stream_lookback", oracle=" UNION ALL ".join(
    f"SELECT source_country AS country, '{n}' AS lookback, count(*) AS n FROM live_articles "
    f"WHERE seendate > {AS_OF} - INTERVAL {m} MINUTE AND seendate <= {AS_OF} GROUP BY 1" for n, m in st.LOOKBACKS))
def st2_stream_lookback(spark):
    return st.lookback_stream(spark, *_landed(spark))


@query("st2_moving_lookbacks", oracle=f"""
WITH t AS (SELECT source_country AS country, seendate,
  time_bucket(INTERVAL 6 HOUR, seendate - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01')
    + unnest(generate_series(1, 28)) * INTERVAL 6 HOUR AS as_of FROM live_articles)
SELECT country, as_of, {", ".join(f"CAST(sum(CASE WHEN seendate > as_of - INTERVAL {m} MINUTE THEN 1 ELSE 0 END) AS BIGINT) AS n_{n}" for n, m in st.LOOKBACKS)}
FROM t GROUP BY 1, 2""")
def st2_moving_lookbacks(spark):
    """All lookbacks at every sixth hour, from the stream's panes of 15 minutes."""
    return st.moving_lookbacks(st.pane_stream(spark, *_landed(spark)))


@query("st3_stream_sliding", oracle="""
WITH t AS (SELECT source_country AS country, time_bucket(INTERVAL 6 HOUR, seendate, TIMESTAMP '1970-01-01')
    - unnest(generate_series(0, 3)) * INTERVAL 6 HOUR AS window_start FROM live_articles)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, country, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def st3_stream_sliding(spark):
    """Windows of a day that start every six hours, as a stream with state that ends."""
    return st.sliding_stream(spark, *_landed(spark))
