"""Structured Streaming for the live feed (ST1-ST5).

The reference polls a news API; here article files arriving in a folder are the
stream.  Every stream keeps its checkpoint in the shared checkpoint folder, so a
restarted query (or a lost executor) resumes from the last committed batch, and
every ``foreachBatch`` write is keyed by batch id (a replayed batch overwrites its
own output).  Tests run with ``Trigger.AvailableNow`` so queries end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expr import normalize_country, source_id
from tessera.operators import live, risk
from tessera.sources import store

ARTICLE_FILE_SCHEMA = T.StructType([
    T.StructField("article_id", T.LongType()), T.StructField("seendate", T.TimestampNTZType()),
    T.StructField("title", T.StringType()), T.StructField("source_country", T.StringType()),
    T.StructField("domain", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("language", T.StringType()),
])
LOOKBACKS = [("15m", 15), ("1h", 60), ("6h", 360), ("1d", 1440), ("3d", 4320), ("7d", 10080)]


def write_article_files(articles: DataFrame, path: str) -> None:
    """Land articles as one folder of parquet files per day (the stream's input)."""
    (articles.select(*ARTICLE_FILE_SCHEMA.names).withColumn("day", F.to_date("seendate"))
     .write.mode("overwrite").partitionBy("day").parquet(path))


def article_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """File-source stream of articles with event time ``seen_ts`` (TIMESTAMP, UTC)."""
    schema = T.StructType(ARTICLE_FILE_SCHEMA.fields + [T.StructField("day", T.DateType())])
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("seen_ts", F.col("seendate").cast("timestamp"))


def ingest_stream(spark: SparkSession, source: str, store_root: str, centroids: DataFrame,
                  checkpoint: str, history: DataFrame | None = None, risk_path: str | None = None) -> None:
    """ST1 (+ ST5): per micro-batch classify, dedupe (title, url), enrich, map to rows and ingest
    idempotently.  Ids that are stored already are dropped by the ingest's anti-join, so there is no
    watermark and articles may arrive in any order.  With ``history`` and ``risk_path`` every batch
    also writes the all-country risk snapshot: the history is collapsed once for all batches, and the live
    counts are running sums to which a batch adds its own new rows (``running_summary``)."""
    s = article_stream(spark, source)
    past = risk.history_summary(history) if history is not None and risk_path is not None else None

    def per_batch(batch: DataFrame, epoch: int) -> None:
        raw = batch.select(*ARTICLE_FILE_SCHEMA.names)
        arts = live.dedupe_articles(live.articles_frame(raw))
        rows = live.to_incident_rows(live.enrich_with_centroids(arts, centroids))
        store.ingest(spark, store_root, rows, str(epoch))
        if past is not None:
            live_counts = running_summary(spark, store_root, f"{risk_path}-sums", epoch)
            snap = risk.country_risk_of(past, live_counts).withColumn("batch_id", F.lit(epoch))
            snap.write.mode("overwrite").parquet(f"{risk_path}/batch={epoch}")

    q = (s.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def running_summary(spark: SparkSession, store_root: str, path: str, epoch: int) -> DataFrame:
    """ST5: counts of all stored rows by country and severity after batch ``epoch``, from the counts after the batch before
    and this batch's new rows.  Only the first batch reads what the store held already.  A replay reads the same
    earlier counts and overwrites its own."""
    counted = lambda rows: risk.live_summary(rows.select(F.col("country_txt").alias("country"), "severity"))
    new = counted(store.read_batch(spark, store_root, str(epoch)))
    sums = spark.read.schema(f"{new.schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, batch long")
    earlier = sums.parquet(path).filter(F.col("batch") < epoch).agg(F.max("batch")).first()[0] if store.exists(spark, path) else None
    if earlier is None:
        before = counted(store.read_live(spark, store_root, without=str(epoch)))
    else:
        before = sums.parquet(path).filter(F.col("batch") == earlier).drop("batch")
    keys = [c for c in new.columns if c != "n"]
    both = before.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))
    both.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
    return spark.read.parquet(f"{path}/batch={epoch}")


def lookback_counts(events: DataFrame, as_of: str = live.AS_OF) -> DataFrame:
    """ST2 (batch): articles per country in each lookback before ``as_of`` (one pass)."""
    t = F.col("date").cast("timestamp_ntz")
    end = F.lit(as_of).cast("timestamp_ntz")
    aggs = [F.sum(F.when((t > end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m))) & (t <= end), 1)
                  .otherwise(0)).alias(f"n_{name}") for name, m in LOOKBACKS]
    return events.groupBy("country").agg(*aggs)


def tumbling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """ST3 (batch or stream): counts per tumbling window, event type and severity."""
    w = F.window(F.col("date").cast("timestamp"), width)
    return (events.groupBy(w.alias("w"), "event", "severity").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event", "severity", "n"))


def surge_alerts(events: DataFrame, width: str = "2 days", min_events: int = 20) -> DataFrame:
    """ST4 (batch): countries whose window count reaches ``min_events``."""
    w = F.window(F.col("date").cast("timestamp"), width)
    counts = events.groupBy(w.alias("w"), "country").agg(F.count(F.lit(1)).alias("n"))
    return (counts.filter(F.col("n") >= min_events)
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "country", "n"))


PANE = "15 minutes"      # every lookback is a whole number of panes
LATENESS = "3 days"      # event time for which a window stays open after its end


def _open_path(out: str, epoch: int) -> str:
    return f"{out}/closed=false/batch={epoch}"


def window_counts(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, width: str, slide: str | None = None,
                  lateness: str = LATENESS) -> None:
    """Counts per event-time window and key of a stream ``events`` (column ``at`` and the keys), as a table under ``out``.

    The state is the table of open windows: a batch adds its rows to the counts that the batch before left open.  Windows
    that ended ``lateness`` before the latest event time of the earlier batches are closed: their counts go to the closed
    part, and the state forgets them.  A row later than that opens its window again with its own count alone, which closes
    in the same batch and is added to the stored ones when the table is read, so no row is dropped however late it comes.
    Each batch reads the state and the clock of the one before and overwrites its own, so a replay changes nothing.
    Rows without a time are in no window.
    """
    keys = [c for c in events.columns if c != "at"]
    window = F.window("at", width, slide) if slide else F.window("at", width)

    def per_batch(batch: DataFrame, epoch: int) -> None:
        clock = spark.read.parquet(f"{out}-clock/batch={epoch - 1}").first()[0] if epoch else None
        rows = batch.select(window.alias("w"), *keys, "at").select("w.start", "w.end", *keys, F.lit(1).cast("long").alias("n"), "at")
        if epoch and store.exists(spark, _open_path(out, epoch - 1)):
            rows = rows.unionByName(spark.read.parquet(_open_path(out, epoch - 1)))
        ended = F.lit(False) if clock is None else F.col("end") <= F.lit(clock).cast("timestamp_ntz") - F.expr(f"INTERVAL {lateness}")
        counts = rows.groupBy("start", "end", *keys).agg(F.sum("n").alias("n"), F.max("at").alias("at"))
        (counts.withColumn("closed", ended).withColumn("batch", F.lit(epoch)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("closed", "batch").parquet(out))
        parts = [p for p in (_open_path(out, epoch), f"{out}/closed=true/batch={epoch}") if store.exists(spark, p)]
        seen = spark.read.parquet(*parts).agg(F.max("at")).first()[0] if parts else None
        latest = max((t for t in (clock, seen) if t is not None), default=None)
        (spark.range(1, numPartitions=1).select(F.lit(latest).cast("timestamp_ntz").alias("clock"))
         .write.mode("overwrite").parquet(f"{out}-clock/batch={epoch}"))
        for old in (_open_path(out, epoch - 2), f"{out}-clock/batch={epoch - 2}"):     # no replay reads these
            store.remove(spark, old)

    q = (events.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def window_totals(spark: SparkSession, out: str) -> DataFrame:
    """(window_start, window_end, keys, n) of ``window_counts``: all closed counts and those that the last batch left open."""
    rows = spark.read.parquet(out)
    last = rows.select(F.max("batch")).scalar()
    keys = [c for c in rows.columns if c not in ("start", "end", "n", "at", "closed", "batch")]
    return (rows.filter(F.col("closed") | (F.col("batch") == last))
            .groupBy(F.col("start").alias("window_start"), F.col("end").alias("window_end"), *keys).agg(F.sum("n").alias("n")))


def surge_stream(spark: SparkSession, source: str, out: str, checkpoint: str, width: str = "2 days",
                 min_events: int = 20, lateness: str = LATENESS) -> DataFrame:
    """ST4 (stream): windowed counts per source country; returns the windows that have reached
    ``min_events`` in what has been read so far."""
    events = article_stream(spark, source).select(F.col("seendate").alias("at"), normalize_country("source_country").alias("ckey"))
    window_counts(spark, events, out, checkpoint, width, lateness=lateness)
    return window_totals(spark, out).filter(F.col("n") >= min_events).select("window_start", "ckey", "n")


def tumbling_stream(spark: SparkSession, source: str, out: str, checkpoint: str, width: str = "1 day") -> DataFrame:
    """ST3 (stream): articles per tumbling window, event type and severity."""
    events = article_stream(spark, source).select(F.col("seendate").alias("at"), live.classify_event(F.col("title")).alias("event"),
                                                  live.classify_severity(F.col("title")).alias("severity"))
    window_counts(spark, events, out, checkpoint, width)
    return window_totals(spark, out).select("window_start", "event", "severity", "n")


def sliding_stream(spark: SparkSession, source: str, out: str, checkpoint: str, width: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """ST3 (stream): articles per source country in windows of ``width`` that start every ``slide``."""
    events = article_stream(spark, source).select(F.col("seendate").alias("at"), F.col("source_country").alias("country"))
    window_counts(spark, events, out, checkpoint, width, slide)
    return window_totals(spark, out).select("window_start", "window_end", "country", "n")


def pane_stream(spark: SparkSession, source: str, out: str, checkpoint: str) -> DataFrame:
    """ST2 (stream): (pane_end, country, n), articles per source country in panes of 15 minutes.  A lookback holds its
    end but not its start, so an article on a border belongs to the pane that ends there."""
    events = article_stream(spark, source).select((F.col("seendate") - F.expr("INTERVAL 1 MICROSECOND")).alias("at"),
                                                  F.col("source_country").alias("country"))
    window_counts(spark, events, out, checkpoint, PANE)
    return window_totals(spark, out).select(F.col("window_end").alias("pane_end"), "country", "n")


def lookbacks_at(panes: DataFrame, as_of: str = live.AS_OF) -> DataFrame:
    """ST2: (country, lookback, n) at one time, a whole number of panes; lookbacks without articles give no row."""
    t, end = F.col("pane_end"), F.lit(as_of).cast("timestamp_ntz")
    hits = F.filter(F.array(*[F.when((t > end - F.expr(f"INTERVAL {m} MINUTES")) & (t <= end), F.lit(name)) for name, m in LOOKBACKS]),
                    lambda x: x.isNotNull())
    return (panes.select("country", "n", F.explode(hits).alias("lookback"))
            .groupBy("country", "lookback").agg(F.sum("n").alias("n")))


def moving_lookbacks(panes: DataFrame, every: str = "6 hours") -> DataFrame:
    """ST2: all lookbacks of every country at every tick of the clock (``every``: whole panes) at which the longest is not
    empty.  Each pane goes to the ticks that still see it, and the counts combine before the shuffle."""
    longest = f"INTERVAL {max(m for _, m in LOOKBACKS)} MINUTES"
    first = F.window(F.col("pane_end") - F.expr("INTERVAL 1 MICROSECOND"), every)
    ticks = (panes.select("country", "n", "pane_end", first.alias("w"))
             .select("country", "n", "pane_end", F.explode(F.sequence(
                 F.col("w.end"), F.col("pane_end") + F.expr(longest) - F.expr("INTERVAL 1 MICROSECOND"), F.expr(f"INTERVAL {every}"))).alias("as_of")))
    aggs = [F.sum(F.when(F.col("pane_end") > F.col("as_of") - F.expr(f"INTERVAL {m} MINUTES"), F.col("n")).otherwise(0)).alias(f"n_{name}")
            for name, m in LOOKBACKS]
    return ticks.groupBy("country", "as_of").agg(*aggs)


def lookback_stream(spark: SparkSession, source: str, out: str, checkpoint: str, as_of: str = live.AS_OF) -> DataFrame:
    """ST2 (stream): articles per source country in each lookback before ``as_of``."""
    return lookbacks_at(pane_stream(spark, source, out, checkpoint), as_of)
