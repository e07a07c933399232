"""CSV files as users have them, streams in any file order, positions, medians and as-of ties."""

import os
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.functions.position import grouped_median, ordered_position
from tessera.operators import scoring
from tessera.operators.asof import asof_join
from tessera.session import scratch_path
from tessera.sources import files
from tessera.streaming import ingest


def test_csv_by_name_with_quotes_and_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'x,city,incident_id,nkill,country_txt,latitude\n'
        '1,"Rome, ""old""\ntown",7,2.5,Italy,41.9\n'
        '2,Bonn,eight,,Germany,north\n'
        '3,Kiel,9,1,Germany\n'
        '4,Graz,10,0,Austria,47.1,extra\n', encoding="latin1")
    path = f"file://{tmp_path}"
    rows = {r["city"]: r for r in files.read_incident_csv(spark, path).collect()}
    assert set(rows) == {'Rome, "old"\ntown', "Bonn"}
    rome = rows['Rome, "old"\ntown']
    assert (rome["incident_id"], rome["country_txt"], rome["latitude"], rome["nkill"], rome["longitude"]) == (7, "Italy", 41.9, 2.5, None)
    assert rows["Bonn"]["incident_id"] is None and rows["Bonn"]["nkill"] is None
    p = files.csv_problems(spark, path).first()
    assert (p["rows"], p["bad_rows"], p["wrong_incident_id"], p["wrong_latitude"], p["wrong_nkill"]) == (4, 2, 1, 1, 0)
    assert p["missing_columns"] == len(files.INCIDENT_SCHEMA.fields) - 5


def test_bounds_only_default_when_missing(spark, tmp_path):
    assert tuple(scoring.read_bounds(spark, f"file://{tmp_path}/none").first()) == (0.0, 5.0)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        scoring.read_bounds(spark, f"file://{tmp_path}/broken").collect()


def test_streams_take_files_in_any_order(spark, small):
    """Days arrive newest first, one file each: nothing is late, lost or counted twice."""
    articles = spark.table("live_articles")
    src = scratch_path(spark, "article-files")
    ingest.write_article_files(articles, src)
    local = src.removeprefix("file:")
    days = sorted(d for d in os.listdir(local) if d.startswith("day="))
    for age, day in enumerate(days):
        for name in os.listdir(f"{local}/{day}"):
            os.utime(f"{local}/{day}/{name}", (1_700_000_000 - age * 1000,) * 2)
    got = ingest.surge_stream(spark, src, scratch_path(spark, "counts"), scratch_path(spark, "ckpt"), min_events=1)
    assert got.agg(F.sum("n")).first()[0] == articles.count()
    hist = spark.createDataFrame([("X", 1.0, 2.0)], "country_txt string, centroid_lat double, centroid_lon double")
    store = scratch_path(spark, "store")
    ingest.ingest_stream(spark, src, store, hist, scratch_path(spark, "ckpt"))
    from tessera.sources.store import read_live
    ids = read_live(spark, store).select("source_id")
    assert ids.count() == ids.distinct().count() == articles.select(F.lower(F.trim("title"))).distinct().count()


def test_window_state_ends_and_late_rows_count(spark, monkeypatch):
    """100 batches, one hour each but every seventh: that one is days late.  The stream equals the batch count after
    every run, and the open windows stay few."""
    import datetime as dt
    start = dt.datetime(2024, 1, 1)
    hours = [h if h % 7 else max(h - 60, 0) for h in range(100)]
    src, out = scratch_path(spark, "t-hours"), scratch_path(spark, "t-windows")
    rows = [(i, start + dt.timedelta(hours=h, minutes=m), "k" if m else "j") for i, h in enumerate(hours) for m in (0, 5, 59)]
    files_df = spark.createDataFrame(rows, "i int, at timestamp_ntz, k string")
    (files_df.repartition(1).sortWithinPartitions("i").write.option("maxRecordsPerFile", 3).parquet(src))
    held, real = [], ingest.store.remove
    monkeypatch.setattr(ingest.store, "remove", lambda s, p: held.append(
        spark.read.parquet(f"{out}/closed=false").groupBy("batch").count().agg(F.max("count")).first()[0]) if "-clock" in p else real(s, p))
    local = src.removeprefix("file:")
    for name in os.listdir(local):      # read in the order written
        if name.startswith("part-"):
            os.utime(f"{local}/{name}", (1_700_000_000 + 100 * int(name.split("-c")[-1].split(".")[0]),) * 2)
    stream = spark.readStream.schema(files_df.schema).option("maxFilesPerTrigger", 1).parquet(src).select("at", "k")
    ingest.window_counts(spark, stream, out, scratch_path(spark, "ckpt"), "2 hours", "1 hour", lateness="6 hours")
    want = {}
    for _, t, k in rows:
        h = t.replace(minute=0)
        for back in (0, 1):
            want[h - dt.timedelta(hours=back), k] = want.get((h - dt.timedelta(hours=back), k), 0) + 1
    got = {(r["window_start"], r["k"]): r["n"] for r in ingest.window_totals(spark, out).collect()}
    assert got == want
    # windows of two hours, closed six hours after their end (one batch later): ten starts and two keys
    assert len(held) == 100 and max(held) <= 24


def test_lookbacks_on_borders(spark):
    import datetime as dt
    end = dt.datetime(2024, 1, 31)
    times = [end, end - dt.timedelta(minutes=15), end - dt.timedelta(minutes=15) + dt.timedelta(microseconds=1), end + dt.timedelta(microseconds=1),
             end - dt.timedelta(days=7), end - dt.timedelta(days=7) + dt.timedelta(microseconds=1)]
    rows = spark.createDataFrame([(t, "x") for t in times], "at timestamp_ntz, country string")
    panes = (rows.groupBy(F.window(F.col("at") - F.expr("INTERVAL 1 MICROSECOND"), ingest.PANE).alias("w"), "country").count()
             .select(F.col("w.end").alias("pane_end"), "country", F.col("count").alias("n")))
    want = {n: sum(end - dt.timedelta(minutes=m) < t <= end for t in times) for n, m in ingest.LOOKBACKS}
    assert {r["lookback"]: r["n"] for r in ingest.lookbacks_at(panes).collect()} == want
    moving = ingest.moving_lookbacks(panes).filter(F.col("as_of") == F.lit(end)).first()
    assert {n: moving[f"n_{n}"] for n, _ in ingest.LOOKBACKS} == want


def test_a_batch_reads_touched_buckets_only(spark, small):
    from tessera.operators import live
    from tessera.plans.q_live import live_feed
    from tessera.sources import store
    rows = live.to_incident_rows(live_feed(spark)).orderBy("source_id")
    root = scratch_path(spark, "t-buckets")
    first, few = rows.limit(60), rows.limit(63).orderBy(F.desc("source_id")).limit(5)
    assert store.ingest(spark, root, first, "1") == first.select("source_id").distinct().count()
    want = {r[0] for r in few.select(store.id_bucket()).collect()}
    seen = {int(f.split("bucket=")[1].split("/")[0]) for f in store.stored_ids(spark, root, few, "2").inputFiles()}
    every = {r[0] for r in first.select(store.id_bucket()).collect()}
    assert seen == want & every and len(seen) < len(every) / 4
    known = {r[0] for r in first.select("source_id").collect()}
    fresh = {r[0] for r in few.select("source_id").collect()} - known
    assert store.ingest(spark, root, few, "2") == len(fresh) == store.ingest(spark, root, few, "2")     # a replay adds the same rows
    ids = [r[0] for r in store.read_live(spark, root).select("source_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == known | fresh


def test_running_risk_equals_batch_after_every_batch(spark, small, monkeypatch):
    """Counts after each batch against the whole store read again; only the first batch reads it."""
    from tessera.operators import risk
    from tessera.operators.prep import scored_incidents
    from tessera.sources import store
    src, root, out = (scratch_path(spark, f"t-risk-{x}") for x in ("src", "store", "out"))
    ingest.write_article_files(spark.table("live_articles"), src)
    checked, whole = [], []
    real, read = ingest.running_summary, store.read_live

    def compare(spark, store_root, path, epoch):
        got = real(spark, store_root, path, epoch)
        all_rows = read(spark, store_root).select(F.col("country_txt").alias("country"), "severity")
        assert sorted(map(str, got.collect())) == sorted(map(str, risk.live_summary(all_rows).select(*got.columns).collect()))
        checked.append(epoch)
        return got

    monkeypatch.setattr(ingest, "running_summary", compare)
    monkeypatch.setattr(store, "read_live", lambda *a, **k: whole.append(1) or read(*a, **k))
    hist = scored_incidents(spark)
    from tessera.operators import geo
    ingest.ingest_stream(spark, src, root, geo.country_centroids(hist), scratch_path(spark, "ckpt"), hist, out)
    assert len(checked) > 2 and len(whole) == 1
    last = spark.read.parquet(out).filter(F.col("batch_id") == max(checked))
    lv = read(spark, root).select(F.col("country_txt").alias("country"), "severity")
    assert last.count() == risk.country_risk(hist, lv).count() > 0


def test_positions_of_sparse_ids(spark):
    ids = [i * 10 ** 9 + (i * 7919) % 13 for i in range(300)]
    df = spark.createDataFrame([(i, i % 3) for i in ids], "id long, day int")
    got = {r["id"]: r["pos"] for r in ordered_position(df, [], "id").collect()}
    assert [got[i] for i in sorted(ids)] == list(range(300))
    got = {r["id"]: r["pos"] for r in ordered_position(df, ["day"], "id").collect()}
    assert [got[i] for i in sorted(ids, key=lambda i: (i % 3, i))] == list(range(300))
    assert ordered_position(df.limit(0), ["day"], "id").count() == 0


def test_ranges_stay_small(spark, monkeypatch):
    """An id far from all others, a hot day and a hot class: ranges hold about the same number of rows."""
    from tessera.functions import position
    ids = [*range(0, 40_000, 2), 9 * 10 ** 18]
    rows = [(i, 0 if i % 10 else i % 7, None if i % 9 == 0 else "hot" if i % 100 else f"c{i % 3}") for i in ids]
    df = spark.createDataFrame(rows, "id long, day int, class string").repartition(8)
    held = []
    real = position.materialize
    monkeypatch.setattr(position, "materialize", lambda d, name: held.append((name, real(d, name))) or held[-1][1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # small ranges would be joined
    try:
        for day, part in (([], []), (["day"], []), (["day"], ["class"])):
            got = {r["id"]: r["pos"] for r in ordered_position(df, day, "id", part).collect()}
            seen = {}
            for i, d, c in sorted(rows, key=lambda r: ((r[2] or "") if part else "", r[1] if day else 0, r[0])):
                seen[c if part else 0] = seen.get(c if part else 0, -1) + 1
                assert got[i] == seen[c if part else 0]
        sizes = [[r["count"] for r in t.groupBy(F.shiftright("_at", position.RANGE_BITS)).count().collect()] for name, t in held if name == "ordered-rows"]
        assert len(sizes) == 3 and all(len(s) == 8 and max(s) < 2 * len(ids) / 8 for s in sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_grouped_median(spark):
    rows = [("a", float((i * 37) % 11) / 2, None if i % 4 else -float(i)) for i in range(41)] + [("b", -3.25, 1.0), ("b", 8.5, None), ("c", None, None)]
    got = {r["k"]: (r["x"], r["y"]) for r in grouped_median(spark.createDataFrame(rows, "k string, x double, y double"), "k", ["x", "y"]).collect()}
    for k in "ab":
        for c in (1, 2):
            assert got[k][c - 1] == statistics.median([r[c] for r in rows if r[0] == k and r[c] is not None])


def test_asof_tie_takes_the_larger_id(spark):
    left = spark.createDataFrame([("k", "2024-01-01 10:00:00")], "key string, t string").withColumn("t", F.col("t").cast("timestamp"))
    for ids in ([10, 11], [11, 10]):
        right = spark.createDataFrame([("k", "2024-01-01 09:59:00", i, i * 2) for i in ids], "key string, u string, id long, v long")
        right = right.withColumn("u", F.col("u").cast("timestamp"))
        out = asof_join(left, right, key="key", left_time="t", right_time="u", right_id="id", right_cols=["v"]).first()
        assert (out["id"], out["v"]) == (11, 22)
