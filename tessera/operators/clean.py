"""Projection, filtering and cleaning of the incident table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions.expr import flag01, nonneg
from tessera.functions.position import top_k

BUSINESS_COLS = R.REQUIRED_COLS


def typed_projection(df: DataFrame) -> DataFrame:
    """S3: the 16 incident columns plus ``incident_id`` with explicit types."""
    return df.select(
        "incident_id",
        F.expr("try_cast(iyear AS INT)").alias("iyear"),
        F.expr("try_cast(imonth AS INT)").alias("imonth"),
        F.expr("try_cast(iday AS INT)").alias("iday"),
        *[F.col(c).cast("string").alias(c) for c in
          ["country_txt", "region_txt", "city", "attacktype1_txt", "weaptype1_txt",
           "targtype1_txt", "gname"]],
        F.expr("try_cast(latitude AS DOUBLE)").alias("latitude"),
        F.expr("try_cast(longitude AS DOUBLE)").alias("longitude"),
        F.expr("try_cast(nkill AS DOUBLE)").alias("nkill"),
        F.expr("try_cast(nwound AS DOUBLE)").alias("nwound"),
        F.expr("try_cast(success AS INT)").alias("success"),
        F.expr("try_cast(suicide AS INT)").alias("suicide"),
    )


def rename_aliases(df: DataFrame) -> DataFrame:
    """Rename an alias only when the source exists and the target does not."""
    cols = set(df.columns)
    mapping = {src: dst for src, dst in R.COL_ALIASES if src in cols and dst not in cols}
    return df.withColumnsRenamed(mapping) if mapping else df


def missing_columns(df: DataFrame, required=R.REQUIRED_COLS) -> list[str]:
    """S6 helper: required columns absent from the schema, in required order."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def validate_columns(df: DataFrame, required=R.REQUIRED_COLS) -> DataFrame:
    """Raise listing the missing columns, else return ``df`` unchanged."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Bad text -> NULL -> 0; casualties clipped >= 0, flags to [0, 1]."""
    return df.withColumns({
        "nkill": nonneg("nkill"),
        "nwound": nonneg("nwound"),
        "success": flag01("success").cast("int"),
        "suicide": flag01("suicide").cast("int"),
    })


def year_range(df: DataFrame, year_min: int = 2000, year_max: int = 2020) -> DataFrame:
    """Inclusive year filter (pushes down to the scan)."""
    return df.filter(F.col("iyear").between(year_min, year_max))


def drop_unknown_target(df: DataFrame, target: str = "attacktype1_txt") -> DataFrame:
    """Drop NULL / empty / 'nan' / 'Unknown' / 'unknown' labels (after trim)."""
    t = F.trim(F.col(target))
    return df.filter(t.isNotNull() & ~t.isin(R.UNKNOWN_LABELS))


def canonical_text(df: DataFrame, cols=R.TEXT_COLS) -> DataFrame:
    """C4: trim text columns and map 'nan' / '' / 'NaN' to NULL."""
    out = {}
    for c in cols:
        t = F.trim(F.col(c))
        out[c] = F.when(t.isin(R.NULL_TEXT), F.lit(None).cast("string")).otherwise(t)
    return df.withColumns(out)


def merge_labels(df: DataFrame) -> DataFrame:
    """Barricade hostage incidents join the kidnapping class."""
    a = F.col("attacktype1_txt")
    return df.withColumn("attacktype1_txt",
                         F.when(a == R.BARRICADE, F.lit(R.KIDNAPPING)).otherwise(a))


def null_island(df: DataFrame) -> DataFrame:
    """|lat| < .01 and |lon| < .01 is missing data, both coordinates -> NULL."""
    bad = (F.abs("latitude") < 0.01) & (F.abs("longitude") < 0.01)
    bad = F.coalesce(bad, F.lit(False))
    return df.withColumns({
        "latitude": F.when(bad, F.lit(None).cast("double")).otherwise(F.col("latitude")),
        "longitude": F.when(bad, F.lit(None).cast("double")).otherwise(F.col("longitude")),
    })


def dedupe_rows(df: DataFrame, cols=BUSINESS_COLS) -> DataFrame:
    """Full-row dedupe on the business columns, keeping the smallest incident_id.

    A grouped min (partial aggregation map-side) rather than a window, so a hot
    duplicate group never lands whole in one task.
    """
    others = [c for c in df.columns if c not in cols and c != "incident_id"]
    agg = [F.min("incident_id").alias("incident_id")]
    agg += [F.min_by(c, "incident_id").alias(c) for c in others]
    return df.groupBy(*cols).agg(*agg).select(df.columns)


def chronological(df: DataFrame) -> DataFrame:
    """Sort by (iyear, imonth, iday), incident_id breaks ties (range-partitioned sort)."""
    return df.orderBy("iyear", "imonth", "iday", "incident_id")


def prepare(df: DataFrame, year_min: int = 2000, year_max: int = 2020) -> DataFrame:
    """The whole cleaning pass in the reference's order."""
    base = df.select("incident_id", *BUSINESS_COLS)
    out = year_range(base, year_min, year_max)
    out = drop_unknown_target(out)
    out = canonical_text(out)
    out = merge_labels(out)
    out = coerce_numeric(out)
    out = null_island(out)
    out = dedupe_rows(out)
    return chronological(out)


def class_distribution(df: DataFrame, target: str = "attacktype1_txt") -> DataFrame:
    """Count, share and rank per class (rank window runs on the aggregate)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    w_all = Window.partitionBy()
    return (counts
            .withColumn("share", F.col("n") / F.sum("n").over(w_all))
            .withColumn("class_rank", F.row_number().over(
                Window.orderBy(F.desc("n"), F.col(target)))))


def coverage_profile(df: DataFrame) -> DataFrame:
    """Rows, year span, distinct countries and groups, rows with coordinates."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("iyear").alias("year_min"),
        F.max("iyear").alias("year_max"),
        F.countDistinct("country_txt").alias("countries"),
        F.countDistinct("gname").alias("groups"),
        F.count("latitude").alias("rows_with_coords"),
    )


def uniform_class_warning(df: DataFrame, target: str = "attacktype1_txt") -> DataFrame:
    """C11: coefficient of variation of class counts and the two warning rules."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("rows"),
        (F.stddev_samp("n") / F.avg("n")).alias("cv"),
    )
    return stats.select(
        "classes", "rows", "cv",
        ((F.col("classes") > 3) & (F.col("cv") < 0.15) & (F.col("rows") < 5000)).alias("warn_train"),
        ((F.col("cv") < 0.20) & (F.col("rows") < 5000)).alias("warn_prepare"),
    )


def country_points(df: DataFrame, country: str | None = None, n: int = 500) -> DataFrame:
    """The first ``n`` rows in incident order of one country, or of every country.

    One country is a filter plus a top-k (no full sort); every country is a salted
    two-stage top-k per country, so a country holding a third of the rows never lands
    whole in one task.
    """
    if country is not None:
        return df.filter(F.col("country_txt") == country).orderBy("incident_id").limit(n)
    return top_k(df, ["country_txt"], [F.asc("incident_id")], n, "incident_id").drop("rank")


def map_points(df: DataFrame, year: int | None = None) -> DataFrame:
    """Map points with coordinates, for year ``year`` or for every year.

    Both predicates reach the scan; the all-years layer keeps ``iyear`` so a year
    slider filters it (a partition-pruned read when the table is written by year).
    """
    keep = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    if year is not None:
        keep = keep & (F.col("iyear") == year)
    return df.filter(keep).select("incident_id", "iyear", "latitude", "longitude", "country_txt", "nkill")


def down_sample(df: DataFrame, n: int = 10_000) -> DataFrame:
    """C14: deterministic sample of ``n`` map points, ordered by an id hash.

    ``orderBy(...).limit(n)`` plans as a per-partition top-k and one merge of
    ``n`` rows per partition, so the cost does not grow with a full sort.
    """
    pts = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    key = F.md5(F.col("incident_id").cast("string"))
    return (pts.withColumn("sample_key", key).orderBy("sample_key", "incident_id").limit(n)
            .select("incident_id", "latitude", "longitude", "sample_key"))
