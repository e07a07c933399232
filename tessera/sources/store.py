"""The live-event store: tables, idempotent ingest, combined view, stats.

Tables are Parquet folders under a root in the shared storage.  Appends are keyed
by batch id (``batch=<id>`` sub-folders written with overwrite), so a replayed batch
rewrites its own folder instead of duplicating rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import live
from tessera.session import materialize

LIVE_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("ingested_at", T.StringType()),
    T.StructField("iyear", T.IntegerType()), T.StructField("imonth", T.IntegerType()),
    T.StructField("iday", T.IntegerType()), T.StructField("country_txt", T.StringType()),
    T.StructField("region_txt", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("attacktype1_txt", T.StringType()), T.StructField("weaptype1_txt", T.StringType()),
    T.StructField("targtype1_txt", T.StringType()), T.StructField("gname", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("nkill", T.IntegerType()), T.StructField("nwound", T.IntegerType()),
    T.StructField("success", T.IntegerType()), T.StructField("suicide", T.IntegerType()),
    T.StructField("source_label", T.StringType()), T.StructField("original_title", T.StringType()),
    T.StructField("severity", T.StringType()),
])
LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("run_at", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("rows_added", T.IntegerType()),
])
HISTORY_COLS = ["iyear", "imonth", "iday", "country_txt", "region_txt", "city", "attacktype1_txt",
                "weaptype1_txt", "targtype1_txt", "gname", "latitude", "longitude", "nkill", "nwound",
                "success", "suicide"]


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ensure_tables(spark: SparkSession, root: str) -> None:
    """Create the live and log tables and the table of ids when absent (idempotent)."""
    for name, schema in (("live_events", LIVE_SCHEMA), ("event_log", LOG_SCHEMA)):
        path = f"{root}/{name}"
        if not exists(spark, path):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=init")
    if not exists(spark, f"{root}/live_ids"):       # a store from before: its ids are dealt out once
        _write_ids(spark.read.parquet(f"{root}/live_events").select("source_id", F.col("batch").cast("string").alias("batch")), root)


ID_BUCKETS = 32


def id_bucket() -> F.Column:
    return F.pmod(F.xxhash64("source_id"), F.lit(ID_BUCKETS)).cast("int")


def _write_ids(ids: DataFrame, root: str) -> None:
    """Add (source_id, batch) to the table of ids; a replayed batch overwrites its own folders."""
    (ids.withColumn("bucket", id_bucket()).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket", "batch").parquet(f"{root}/live_ids"))


def stored_ids(spark: SparkSession, root: str, rows: DataFrame, batch_id: str) -> DataFrame:
    """The stored ids that may equal one of ``rows``, without those of this batch's own folder (so a replay sees the same state).

    Ids lie in folders by hash: only the folders that the rows' own ids fall into are read, so a batch's
    cost does not grow with the store.
    """
    touched = [r[0] for r in rows.select(id_bucket()).distinct().collect()]          # ID_BUCKETS numbers at most
    paths = [p for b in touched if b is not None and exists(spark, p := f"{root}/live_ids/bucket={b}")]
    if not paths:
        return spark.createDataFrame([], "source_id string")
    ids = spark.read.schema("source_id string, bucket int, batch string").option("basePath", f"{root}/live_ids").parquet(*paths)
    return ids.filter(F.col("batch") != F.lit(str(batch_id))).select("source_id")


def read_live(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    """The live table, or what it holds besides one batch."""
    rows = spark.read.schema(T.StructType([*LIVE_SCHEMA.fields, T.StructField("batch", T.StringType())])).parquet(f"{root}/live_events")
    return (rows if without is None else rows.filter(F.col("batch") != F.lit(without))).select(*LIVE_SCHEMA.names)


def read_batch(spark: SparkSession, root: str, batch_id: str) -> DataFrame:
    """The rows that one batch added."""
    return spark.read.schema(LIVE_SCHEMA).parquet(f"{root}/live_events/batch={batch_id}").select(*LIVE_SCHEMA.names)


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/event_log").select(*LOG_SCHEMA.names)


def ingest(spark: SparkSession, root: str, rows: DataFrame, batch_id: str, source: str = "GDELT",
           as_of: str = live.AS_OF) -> int:
    """L13 + L14: append rows whose source_id is not stored yet (one per id) and a log row.

    Returns the number of rows added.  The new rows are written first (keyed by batch
    id), then counted from the written table; a replay of the same batch id rewrites
    the same folder.
    """
    ensure_tables(spark, root)
    rows = materialize(rows, "ingest-rows")
    fresh = live.new_rows(rows, stored_ids(spark, root, rows, batch_id)).select(*LIVE_SCHEMA.names)
    out = f"{root}/live_events/batch={batch_id}"
    fresh.write.mode("overwrite").parquet(out)
    written = spark.read.parquet(out)
    count = written.count()
    if count:
        _write_ids(written.select("source_id", F.lit(str(batch_id)).alias("batch")), root)
        live.ingest_log_row(spark, written, source, as_of).write.mode("overwrite").parquet(
            f"{root}/event_log/batch={batch_id}")
    return count


def combined(history: DataFrame, live_rows: DataFrame) -> DataFrame:
    """History (16 columns + 'GTD') UNION ALL live (16 columns + its source label)."""
    h = history.select(*HISTORY_COLS, F.lit("GTD").alias("data_source"))
    lv = live_rows.select(*HISTORY_COLS, F.col("source_label").alias("data_source"))
    return h.unionByName(lv)


def load_combined(spark: SparkSession, history: DataFrame, root: str | None) -> DataFrame:
    """The combined table; history alone when the live table is missing."""
    if root is None or not exists(spark, f"{root}/live_events"):
        return combined(history, spark.createDataFrame([], LIVE_SCHEMA))
    return combined(history, read_live(spark, root))


def store_stats(history: DataFrame, live_rows: DataFrame) -> DataFrame:
    """History / live / total rows, distinct live countries, last ingest — one row."""
    h = history.agg(F.count(F.lit(1)).alias("gtd_rows"))
    lv = live_rows.agg(F.count(F.lit(1)).alias("live_rows"),
                       F.countDistinct("country_txt").alias("live_countries"),
                       F.max("ingested_at").alias("last_ingest"))
    return h.select(
        "gtd_rows", lv.select("live_rows").scalar().alias("live_rows"),
        (F.col("gtd_rows") + lv.select("live_rows").scalar()).alias("total_rows"),
        lv.select("live_countries").scalar().alias("live_countries"),
        F.coalesce(lv.select("last_ingest").scalar(), F.lit("Never")).alias("last_ingest"))


def live_listing(live_rows: DataFrame) -> DataFrame:
    """Live events newest first."""
    return live_rows.orderBy(F.desc("iyear"), F.desc("imonth"), F.desc("iday"), "source_id")


def log_listing(log: DataFrame) -> DataFrame:
    """Ingest runs newest first."""
    return log.orderBy(F.desc("run_at"), "run_id")
