"""Live feed: keyword rules, parsing, dedupe, country matching, schema mapping, ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions.expr import normalize_country, ordered_rules, source_id
from tessera.session import materialize

GDELT_DATE_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
AS_OF = "2024-01-31 00:00:00"


def classify_event(title: Column) -> Column:
    """L1: first matching event type (substring match, so 'ied' hits 'died')."""
    return ordered_rules(F.lower(title), R.EVENT_RULES, R.EVENT_DEFAULT)


def classify_severity(title: Column) -> Column:
    """L2: first matching severity level, else Low."""
    return ordered_rules(F.lower(title), R.SEVERITY_RULES, R.SEVERITY_DEFAULT)


def severity_points(level: Column) -> Column:
    """L3: 20 / 45 / 70 / 90, default 20."""
    expr = None
    for label, pts in R.SEVERITY_POINTS.items():
        expr = F.when(level == label, F.lit(pts)) if expr is None else expr.when(level == label, F.lit(pts))
    return expr.otherwise(F.lit(R.SEVERITY_POINTS["Low"]))


def parse_feed_date(raw: Column, as_of: str = AS_OF) -> Column:
    """L4: GDELT ``20240101T000007Z`` or ISO text; bad or NULL -> ``as_of`` (never now())."""
    parsed = F.coalesce(F.try_to_timestamp(raw, F.lit(GDELT_DATE_FORMAT)),
                        F.try_to_timestamp(raw))
    return F.coalesce(parsed.cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz"))


def articles_frame(raw: DataFrame) -> DataFrame:
    """Articles as the fetch step shapes them (country, location, event, title, date, ...).

    ``raw`` has article_id, title, source_country, domain, url, language and either a
    timestamp ``seendate`` or a text ``seendate_raw``.
    """
    date = (parse_feed_date(F.col("seendate_raw")) if "seendate_raw" in raw.columns
            else F.col("seendate").cast("timestamp_ntz"))
    return raw.select(
        "article_id",
        F.col("source_country").alias("country"), F.col("source_country").alias("location"),
        classify_event(F.col("title")).alias("event"), "title", date.alias("date"),
        F.col("domain").alias("source"), "url",
        classify_severity(F.col("title")).alias("severity"), "language")


def dedupe_articles(df: DataFrame, keys=("title", "url"), order: str = "article_id") -> DataFrame:
    """One row per (title, url), the first by ``order`` wins.

    A grouped ``min_by`` (map-side partial aggregation) instead of a window, so a
    repeated title held by a third of the feed is still combined in every task.
    """
    cols = [c for c in df.columns]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(order)).alias("r"))
            .select("r.*"))


def country_candidates(centroids: DataFrame) -> DataFrame:
    """Country names as match candidates, in the reference's order (sorted country_txt)."""
    return (centroids.select("country_txt", "centroid_lat", "centroid_lon",
                             normalize_country("country_txt").alias("cand"))
            .filter(F.col("cand") != ""))


MAX_COUNTRIES = 2_000  # names that the map of the scan may hold; more are joined


def enrich_with_centroids(live: DataFrame, centroids: DataFrame,
                          id_col: str = "article_id") -> DataFrame:
    """L7 + L8: exact normalised country first, else a whole-word country name in the title.

    A whole-word match is an equal word n-gram of the title; of several the first country in
    order wins.  Unmatched rows keep their country and get NULL coordinates.  Up to
    ``MAX_COUNTRIES`` names are a map that a scalar subquery hands to the scan of the feed: it is
    joined with nothing and not shuffled, so a country or word that most articles share costs
    nothing extra.  More names are joined with the n-grams (``_joined_matches``).
    """
    names = (country_candidates(centroids).groupBy("cand")
             .agg(F.min(F.struct("country_txt", "centroid_lat", "centroid_lon")).alias("m")))
    names = materialize(names, "country-names")
    size = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(F.split("cand", " "))), F.lit(1)).alias("words")).first()
    row = F.struct(*[F.col(f"`{c}`") for c in live.columns])
    out = live.select(row.alias("_row"), normalize_country("country").alias("_c"), normalize_country("title").alias("_t"))
    if size["n"] <= MAX_COUNTRIES:
        known = names.agg(F.map_from_entries(F.collect_list(F.struct("cand", "m")))).scalar()
        first = "array_min(transform(array_intersect(%s, map_keys(_known)), g -> _known[g]))"
        out = out.withColumn("_known", known)
        out = out.withColumn("_m", F.coalesce(F.expr("try_element_at(_known, _c)"), F.expr(first % _grams(size["words"]))))
    else:
        out = _joined_matches(out, names, size["words"])
    kept = [F.col(f"_row.`{c}`").alias(c) for c in live.columns if c not in ("country", "latitude", "longitude")]
    out = out.select(*kept, F.coalesce("_m.country_txt", "_row.country").alias("country"),
                     F.col("_m.centroid_lat").alias("latitude"), F.col("_m.centroid_lon").alias("longitude"))
    return out.select(*dict.fromkeys([*live.columns, "latitude", "longitude"]))


def _grams(words: int) -> str:
    """SQL for the distinct runs of up to ``words`` words of ``_t``."""
    w = "split(_t, ' ')"
    return f"""array_distinct(flatten(transform(sequence(1, size({w})), i -> transform(
      sequence(1, least({words}, size({w}) - i + 1)), k -> array_join(slice({w}, i, k), ' ')))))"""


def _joined_matches(rows: DataFrame, names: DataFrame, words: int) -> DataFrame:
    """``rows`` (_row, _c, _t) with their match _m by joins: equal names first, then the n-grams of each distinct title
    that has none.  Repeated titles collapse before the join, and AQE splits those that many rows share."""
    exact = rows.join(names.select(F.col("cand").alias("_c"), F.col("m").alias("_exact")), "_c", "left")
    grams = exact.filter(F.col("_exact").isNull()).select("_t").distinct().select("_t", F.explode(F.expr(_grams(words))).alias("cand"))
    titled = grams.join(names, "cand").groupBy("_t").agg(F.min("m").alias("_titled"))
    return exact.join(titled, "_t", "left").withColumn("_m", F.coalesce("_exact", "_titled"))


def historical_fallback(incidents: DataFrame, limit: int = 50, as_of: str = AS_OF) -> DataFrame:
    """The newest ``limit`` incidents shaped as live events (top-k, not a full sort)."""
    top = incidents.orderBy(F.desc("iyear"), F.desc("imonth"), F.desc("iday"),
                            F.asc("incident_id")).limit(limit)
    w = Window.orderBy(F.desc("iyear"), F.desc("imonth"), F.desc("iday"), F.asc("incident_id"))
    top = top.withColumn("pos", F.row_number().over(w) - 1)  # window over <= limit rows
    made = F.try_make_timestamp(F.col("iyear"), F.col("imonth"), F.col("iday"), F.lit(0), F.lit(0),
                                F.lit(0)).cast("timestamp_ntz")
    fallback = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.col("pos"))
    nk = F.col("nkill")
    sev = F.when(nk > 10, "Critical").when(nk > 0, "High").otherwise("Medium")
    return top.select(
        "pos", F.coalesce(F.col("country_txt"), F.lit("Unknown")).alias("country"),
        F.coalesce(F.col("city"), F.lit("Unknown")).alias("location"),
        F.coalesce(F.col("attacktype1_txt"), F.lit("Security Event")).alias("event"),
        F.format_string(R.FALLBACK_TITLE, F.coalesce("attacktype1_txt", F.lit("Attack")),
                        F.coalesce("city", F.lit("Unknown"))).alias("title"),
        F.coalesce(made, fallback).alias("date"),
        F.lit(R.FALLBACK_SOURCE).alias("source"), F.lit(R.FALLBACK_URL).alias("url"),
        sev.alias("severity"), F.lit("English").alias("language"), "latitude", "longitude")


def resolve_feed(live: DataFrame, fallback: DataFrame) -> DataFrame:
    """Live rows when there are any, else the historical fallback."""
    cols = ["country", "location", "event", "title", "date", "source", "url", "severity", "language"]
    both = (live.select(*cols, F.lit(0).alias("priority"))
            .unionByName(fallback.select(*cols, F.lit(1).alias("priority"))))
    best = both.select(F.min("priority")).scalar()
    return both.filter(F.col("priority") == best).drop("priority")


def _lookup(pairs, key: Column, default: str | int) -> Column:
    m = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def to_incident_rows(enriched: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Live event -> the 21-column live_events row (lookups are literal maps)."""
    country = F.coalesce(F.nullif(F.trim(F.col("country")), F.lit("")), F.lit("Unknown"))
    title = F.coalesce(F.trim(F.col("title")), F.lit(""))
    location = F.coalesce(F.nullif(F.trim(F.col("location")), F.lit("")), country)
    attack = _lookup(R.EVENT_TO_ATTACK, F.col("event"), "Unknown")
    d = F.col("date")
    return enriched.select(
        *([c for c in ["article_id"] if c in enriched.columns]),
        source_id(title).alias("source_id"),
        F.lit(as_of.replace(" ", "T") + "+00:00").alias("ingested_at"),
        F.year(d).alias("iyear"), F.month(d).alias("imonth"), F.dayofmonth(d).alias("iday"),
        country.alias("country_txt"),
        _lookup(R.COUNTRY_TO_REGION, country, "Unknown").alias("region_txt"),
        F.when(location != country, location).alias("city"),
        attack.alias("attacktype1_txt"),
        _lookup(R.ATTACK_TO_WEAPON, attack, "Unknown").alias("weaptype1_txt"),
        F.lit("Unknown").alias("targtype1_txt"), F.lit("Unknown Group").alias("gname"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        _lookup(R.SEVERITY_TO_NKILL, F.col("severity"), 0).cast("int").alias("nkill"),
        _lookup(R.SEVERITY_TO_NWOUND, F.col("severity"), 0).cast("int").alias("nwound"),
        F.lit(1).alias("success"), F.lit(0).alias("suicide"),
        F.lit("GDELT").alias("source_label"), title.alias("original_title"), "severity")


def new_rows(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """L13 delta: drop ids already stored (anti join), then one row per id (first wins)."""
    fresh = candidates.join(stored.select("source_id"), "source_id", "left_anti")
    order = "article_id" if "article_id" in fresh.columns else "source_id"
    return dedupe_articles(fresh, keys=("source_id",), order=order)


def ingest_log_row(spark: SparkSession, batch: DataFrame, source: str, as_of: str = AS_OF) -> DataFrame:
    """Run id, time, source, rows added.  The run id is a hash of the number of ids and
    their combined (order-free) hash: one aggregate of fixed size."""
    ids = F.xxhash64("source_id")
    return batch.agg(
        F.substring(F.sha2(F.concat_ws(":", F.hex(F.bit_xor(ids)), F.count(F.lit(1)).cast("string")), 256),
                    1, 12).alias("run_id"),
        F.count(F.lit(1)).cast("int").alias("rows_added")).select(
        "run_id", F.lit(as_of).alias("run_at"), F.lit(source).alias("source"), "rows_added")


def route_intent(text: Column) -> Column:
    """Six ordered keyword rules on the lower-cased message, then 'general'."""
    return ordered_rules(F.lower(text), R.INTENT_RULES, R.INTENT_DEFAULT)


def history_window(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` turns of every conversation, role mapped to user / model.

    The window is partitioned by conversation (bounded by its turn count).
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
            .select("conv_id", "turn",
                    F.when(F.col("role") == "user", "user").otherwise("model").alias("role"),
                    "content"))
