"""Severity scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.expr import round_even
from tessera.operators import scoring
from tessera.plans.registry import query
from tessera.plans.sqlparts import normalise, raw_severity, tsi_default
from tessera.session import scratch_path


@query("t1_raw_severity", oracle=f"""
SELECT incident_id, round_even({raw_severity()}, 6) AS tsi_raw FROM incidents""")
def t1_raw_severity(spark):
    df = spark.table("incidents")
    return df.select("incident_id", round_even(scoring.raw_severity_expr(df), 6).alias("tsi_raw"))


@query("t2_severity_stored_bounds", oracle=f"""
SELECT incident_id, {tsi_default()} AS tsi FROM incidents""")
def t2_severity_stored_bounds(spark):
    return scoring.score_with_bounds(spark.table("incidents")).select("incident_id", "tsi")


@query("t3_severity_self_normalised", oracle=f"""
WITH r AS (SELECT incident_id, {raw_severity()} AS raw FROM incidents),
b AS (SELECT min(raw) AS mn, max(raw) AS mx FROM r)
SELECT incident_id, {normalise('raw', 'mn', 'mx')} AS tsi FROM r, b""")
def t3_severity_self_normalised(spark):
    return scoring.score_self_normalised(spark.table("incidents")).select("incident_id", "tsi")


@query("t4_single_incident_score", oracle="""
SELECT incident_id, CASE WHEN 5.0 = 0.0 THEN 0.0 ELSE round_even(least(greatest(
  (0.5 * ln(1 + greatest(nkill, 0.0)) + 0.3 * ln(1 + greatest(nwound, 0.0))
   + 0.15 * least(greatest(CAST(success AS DOUBLE), 0.0), 1.0)
   + 0.05 * least(greatest(CAST(claimed AS DOUBLE), 0.0), 1.0) - 0.0) / (5.0 - 0.0) * 100.0,
  0.0), 100.0), 2) END AS tsi
FROM incidents WHERE nkill IS NOT NULL AND nwound IS NOT NULL""")
def t4_single_incident_score(spark):
    df = spark.table("incidents").filter(F.col("nkill").isNotNull() & F.col("nwound").isNotNull())
    return df.select("incident_id", scoring.single_score(
        F.col("nkill"), F.col("nwound"), F.col("success").cast("double"),
        F.col("claimed").cast("double")).alias("tsi"))


@query("t5_severity_label", oracle=f"""
WITH s AS (SELECT incident_id, {tsi_default()} AS tsi FROM incidents)
SELECT incident_id, tsi, CASE WHEN tsi >= 75 THEN 'CRITICAL' WHEN tsi >= 50 THEN 'HIGH'
  WHEN tsi >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS tsi_label FROM s""")
def t5_severity_label(spark):
    df = scoring.score_with_bounds(spark.table("incidents"))
    return df.select("incident_id", "tsi", scoring.severity_label("tsi").alias("tsi_label"))


@query("t6_calibration_bounds", oracle=f"""
SELECT round_even(min({raw_severity()}), 6) AS min_raw, round_even(max({raw_severity()}), 6) AS max_raw
FROM incidents""")
def t6_calibration_bounds(spark):
    b = scoring.calibration_bounds(spark.table("incidents"))
    return b.select(round_even("min_raw", 6).alias("min_raw"), round_even("max_raw", 6).alias("max_raw"))


@query("t7_power_law_score", oracle="""
SELECT incident_id, round_even(pow(3.0 * greatest(coalesce(nkill, 0.0), 0.0)
  + 1.0 * greatest(coalesce(nwound, 0.0), 0.0), 0.85)
  * CASE WHEN least(greatest(coalesce(CAST(success AS DOUBLE), 0.0), 0.0), 1.0) >= 1 THEN 1.0 ELSE 0.4 END, 6)
  AS tsi_power FROM incidents""")
def t7_power_law_score(spark):
    df = scoring.power_law_score(spark.table("incidents"))
    return df.select("incident_id", round_even("tsi_power", 6).alias("tsi_power"))


@query("s15_bounds_roundtrip", oracle=f"""
WITH b AS (SELECT min({raw_severity()}) AS mn, max({raw_severity()}) AS mx FROM incidents)
SELECT incident_id, {normalise(raw_severity(), 'mn', 'mx')} AS tsi FROM incidents, b""")
def s15_bounds_roundtrip(spark):
    """T6 -> S15 sink -> S15 source -> T2: score with bounds read back from storage."""
    df = spark.table("incidents")
    path = scratch_path(spark, "tsi_bounds")
    scoring.write_bounds(scoring.calibration_bounds(df), path)
    bounds = scoring.read_bounds(spark, path)
    return scoring.score_with_bounds(df, bounds).select("incident_id", "tsi")
