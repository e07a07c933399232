"""Live feed rules, country matching, report text, stream = batch."""

from pyspark.sql import functions as F

from tessera.operators import live, risk


def test_event_and_severity_rules(spark):
    df = spark.createDataFrame([("Border clash reported",), ("Missile strike on depot",),
                                ("Three killed in town",), ("Calm day in capital",)], "title string")
    out = df.select(live.classify_event(F.col("title")).alias("e"), live.classify_severity(F.col("title")).alias("s")).collect()
    assert out[0]["e"] == "Border Clash"
    assert out[1]["e"] == "Missile / Rocket"
    assert out[2]["s"] == "High"
    assert out[3]["s"] == "Low"


def test_title_match_and_median_centroid(spark):
    hist = spark.createDataFrame([("Iraq", 10.0, 20.0), ("Iraq", 12.0, 22.0)],
                                 "country_txt string, latitude double, longitude double")
    from tessera.operators import geo
    cent = geo.country_centroids(hist)
    lv = spark.createDataFrame([(1, "Unknown", "Blast in Iraq kills 3"), (2, "Unknown", "Nothing in Iraqi news")],
                               "article_id long, country string, title string")
    out = {r["article_id"]: r for r in live.enrich_with_centroids(lv, cent).collect()}
    assert out[1]["country"] == "Iraq" and (out[1]["latitude"], out[1]["longitude"]) == (11.0, 21.0)
    assert out[2]["country"] == "Unknown" and out[2]["latitude"] is None


def test_country_names_beyond_the_map_are_joined(spark, monkeypatch):
    cent = spark.createDataFrame([(n, float(i), -float(i)) for i, n in enumerate(["Iraq", "iraq ", "South Sudan", "Sudan", "Sri Lanka", None])],
                                 "country_txt string, centroid_lat double, centroid_lon double")
    titles = ["Blast in Iraq", "Talks in South Sudan", "Sudan and Iraq meet", "No Iraqi news", "", None, "Sri Lanka", "  SRI   LANKA  floods"]
    rows = [(i, c, t) for i, (c, t) in enumerate((c, t) for c in ("Unknown", "SUDAN", None, "") for t in titles * 3)]
    lv = spark.createDataFrame(rows, "article_id long, country string, title string")
    by_map = live.enrich_with_centroids(lv, cent).collect()
    monkeypatch.setattr(live, "MAX_COUNTRIES", 0)
    joined = live.enrich_with_centroids(lv, cent)
    assert sorted(map(str, joined.collect())) == sorted(map(str, by_map)) and len(by_map) == len(rows)
    found = {(r["title"], r["country"]) for r in by_map if r["article_id"] < 8}
    assert {("Blast in Iraq", "Iraq"), ("Talks in South Sudan", "South Sudan"), ("Sudan and Iraq meet", "Iraq"), ("No Iraqi news", "Unknown")} <= found
    assert live.enrich_with_centroids(lv, cent.limit(0)).filter("latitude is not null").count() == 0


def test_report_text_has_country_and_score(spark):
    facts = spark.createDataFrame(
        [("Iraq", 1, 5.0, None, "Baghdad", 42, "Medium", 3, 1.0, 2.0, 3.0, 4.0, 5.0, "Border Clash")],
        "country_txt string, historical_incidents long, historical_fatalities double, activity_delta_pct double, "
        "top_area string, score int, level string, live_n long, c_activity double, c_recent double, "
        "c_fatalities double, c_density double, c_instability double, event_mix string")
    text = risk.report_text(facts, "2000-2001").first()["report"]
    assert "Iraq" in text and "(42/100)" in text and "MEDIUM" in text


def test_stream_equals_batch(spark, small):
    from tessera.operators import geo
    from tessera.operators.prep import scored_incidents
    from tessera.plans.q_live import live_feed
    from tessera.session import scratch_path
    from tessera.sources import store
    from tessera.streaming import ingest as st
    src = scratch_path(spark, "t-articles")
    st.write_article_files(spark.table("live_articles"), src)
    root = scratch_path(spark, "t-store")
    st.ingest_stream(spark, src, root, geo.country_centroids(scored_incidents(spark)), scratch_path(spark, "t-ckpt"))
    streamed = {r["source_id"] for r in store.read_live(spark, root).select("source_id").collect()}
    rows = live.to_incident_rows(live_feed(spark))
    batch = {r["source_id"] for r in live.new_rows(rows, spark.createDataFrame([], "source_id string")).collect()}
    assert streamed == batch
    assert store.read_live(spark, root).groupBy("source_id").count().filter("count > 1").count() == 0


def test_ingest_is_idempotent(spark, small):
    from tessera.plans.q_live import live_feed
    from tessera.session import scratch_path
    from tessera.sources import store
    rows = live.to_incident_rows(live_feed(spark))
    root = scratch_path(spark, "t-idem")
    n1 = store.ingest(spark, root, rows, "1")
    n1_again = store.ingest(spark, root, rows, "1")   # replay of the same batch
    n2 = store.ingest(spark, root, rows, "2")          # new batch, same rows
    assert n1 > 0 and n1_again == n1 and n2 == 0
    assert store.read_live(spark, root).count() == n1
