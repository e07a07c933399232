"""File sources and sinks: incident CSV, SQL over the dataset, article and asset JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.live import parse_feed_date

INCIDENT_SCHEMA = T.StructType([
    T.StructField("incident_id", T.LongType()), T.StructField("iyear", T.IntegerType()),
    T.StructField("imonth", T.IntegerType()), T.StructField("iday", T.IntegerType()),
    T.StructField("country_txt", T.StringType()), T.StructField("region_txt", T.StringType()),
    T.StructField("city", T.StringType()), T.StructField("attacktype1_txt", T.StringType()),
    T.StructField("weaptype1_txt", T.StringType()), T.StructField("targtype1_txt", T.StringType()),
    T.StructField("gname", T.StringType()), T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()), T.StructField("nkill", T.DoubleType()),
    T.StructField("nwound", T.DoubleType()), T.StructField("success", T.IntegerType()),
    T.StructField("suicide", T.IntegerType()), T.StructField("claimed", T.IntegerType()),
])

TABLE_TOKEN = "incidents"


CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def read_csv_text(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                  multi_line: bool = True) -> tuple[DataFrame, list[str]]:
    """Every column of a header CSV as text, and ``_bad`` for rows that do not fit the header.

    Fields may hold quoted commas, doubled quotes and newlines.  Newlines in fields mean that
    a file is read by one task; ``multi_line=False`` splits large files that have none.
    The header's names are read first, so column order does not matter; files of a folder must
    share one header (else the read fails).
    """
    reader = spark.read.options(**CSV_OPTIONS).option("encoding", encoding).option("multiLine", multi_line)
    names = reader.option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_bad"]])
    df = (reader.schema(schema).option("enforceSchema", False).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_bad").csv(path))
    return df, names


def read_incident_csv(spark: SparkSession, path: str, schema: T.StructType | None = INCIDENT_SCHEMA,
                      encoding: str = "ISO-8859-1", multi_line: bool = True) -> DataFrame:
    """The columns of ``schema`` by name, in any order among others.

    Columns that the file lacks are NULL, and so are values that are not of their type
    (``csv_problems`` counts both).  Rows that do not fit the header are left out and counted there.
    ``schema=None`` infers types of all columns (one extra pass, for unknown files).
    """
    if schema is None:
        return (spark.read.options(**CSV_OPTIONS).option("encoding", encoding).option("multiLine", multi_line)
                .option("inferSchema", True).csv(path))
    df, names = read_csv_text(spark, path, encoding, multi_line)
    return df.filter("_bad IS NULL").select(*[
        F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def csv_problems(spark: SparkSession, path: str, schema: T.StructType = INCIDENT_SCHEMA,
                 encoding: str = "ISO-8859-1", multi_line: bool = True) -> DataFrame:
    """One row: rows, rows that do not fit the header, missing columns, and for each column the
    values that are not of its type."""
    df, names = read_csv_text(spark, path, encoding, multi_line)
    here = [f for f in schema.fields if f.name in names]
    wrong = [F.count_if(F.col("_bad").isNull() & F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull())
             .alias(f"wrong_{f.name}") for f in here if not isinstance(f.dataType, T.StringType)]
    missing = F.lit(len(schema.fields) - len(here)).alias("missing_columns")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_bad").isNotNull()).alias("bad_rows"),
                  *wrong).withColumn("missing_columns", missing)


def write_csv(df: DataFrame, path: str, encoding: str = "ISO-8859-1") -> None:
    """Header CSV (one file per partition), quoted so that any text can be read back."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).option("encoding", encoding).csv(path)


def query_data(spark: SparkSession, sql: str, table: str = TABLE_TOKEN) -> DataFrame:
    """SQL over the registered dataset; the text must name the table."""
    if table not in sql:
        raise ValueError(f"Query must reference {table}.")
    return spark.sql(sql)


# ---- S8: article JSON ------------------------------------------------------------------

def read_article_payloads(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Feed payloads ``{"articles": [...]}`` -> one row per article with the
    reference's fallbacks: title -> 'Untitled event'; sourceCountry / sourcecountry ->
    'Unknown'; domain -> sourceCollection -> 'GDELT'; language -> 'unknown'.

    Each article is kept as JSON text and read by case-sensitive JSON paths, because
    the two country spellings collide under Spark's case-insensitive column names.
    """
    raw = spark.read.option("wholetext", multi_line).text(path)
    arts = raw.select(F.explode(F.from_json("value", "struct<articles: array<string>>")["articles"]).alias("j"))

    def field(name):
        return F.nullif(F.get_json_object("j", f"$.{name}"), F.lit(""))  # '' is falsy in the reference
    return arts.select(
        field("article_id").cast("long").alias("article_id"),
        F.coalesce(field("title"), F.lit("Untitled event")).alias("title"),
        F.coalesce(field("sourceCountry"), field("sourcecountry"), F.lit("Unknown")).alias("source_country"),
        field("seendate").alias("seendate_raw"),
        F.coalesce(field("domain"), field("sourceCollection"), F.lit("GDELT")).alias("domain"),
        field("url").alias("url"), F.coalesce(field("language"), F.lit("unknown")).alias("language"))


def write_article_payloads(articles: DataFrame, path: str, per_payload: int = 100) -> None:
    """Shape a table of articles as feed payload files (bounded groups of ``per_payload``)."""
    row = F.struct(
        "article_id", F.when(F.col("article_id") % 17 != 0, F.col("title")).alias("title"),
        F.when((F.col("article_id") % 2 == 0) & (F.col("source_country") != "Unknown"),
               F.col("source_country")).alias("sourceCountry"),
        F.when((F.col("article_id") % 2 == 1) & (F.col("source_country") != "Unknown"),
               F.col("source_country")).alias("sourcecountry"),
        F.date_format("seendate", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"),
        F.when(F.col("article_id") % 5 != 0, F.col("domain")).alias("domain"),
        F.when(F.col("article_id") % 10 != 0, F.lit("web")).alias("sourceCollection"),
        "url", "language")
    payloads = (articles.groupBy(F.floor(F.col("article_id") / per_payload).alias("payload"))
                .agg(F.collect_list(row).alias("articles")))
    payloads.select(F.to_json(F.struct("articles")).alias("value")).write.mode("overwrite").text(path)


def articles_from_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Parsed payload articles shaped like ``live_articles`` (seendate parsed, L4)."""
    a = read_article_payloads(spark, path)
    return a.withColumn("seendate", parse_feed_date(F.col("seendate_raw"))).drop("seendate_raw")


# ---- S9: asset JSON --------------------------------------------------------------------

ASSET_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("country", T.StringType()), T.StructField("status", T.StringType()),
])


def read_assets(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Asset records (JSON lines, or one JSON array per file with ``multi_line``)."""
    return spark.read.schema(ASSET_SCHEMA).option("multiLine", multi_line).json(path)
