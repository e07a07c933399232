"""Severity scoring (T1-T7) and the calibration-bounds table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import rules as R
from tessera.functions.expr import flag01, nonneg, round_even


def raw_severity_expr(df: DataFrame) -> Column:
    """.50 ln(1+kill) + .30 ln(1+wound) + .15 success + .05 claimed.

    Missing columns default like the reference: success 1, the others 0.
    """
    cols = set(df.columns)
    kill = nonneg("nkill") if "nkill" in cols else F.lit(0.0)
    wound = nonneg("nwound") if "nwound" in cols else F.lit(0.0)
    success = flag01("success") if "success" in cols else F.lit(1.0)
    claimed = flag01("claimed") if "claimed" in cols else F.lit(0.0)
    return (F.lit(R.W_KILL) * F.log1p(kill) + F.lit(R.W_WOUND) * F.log1p(wound)
            + F.lit(R.W_SUCCESS) * success + F.lit(R.W_CLAIMED) * claimed)


def normalise(raw: Column, mn: Column, mx: Column) -> Column:
    """Min-max to 0-100, clipped, round half-even to 2; degenerate -> 0."""
    scaled = (raw - mn) / (mx - mn) * F.lit(100.0)
    clipped = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0))
    return F.when((mx == mn) | (mx == 0), F.lit(0.0)).otherwise(round_even(clipped, 2))


def with_raw_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("tsi_raw", raw_severity_expr(df))


def calibration_bounds(df: DataFrame) -> DataFrame:
    """One row (min_raw, max_raw) over the whole table (partial agg per task)."""
    return with_raw_severity(df).agg(F.min("tsi_raw").alias("min_raw"),
                                     F.max("tsi_raw").alias("max_raw"))


BOUNDS_SCHEMA = T.StructType([T.StructField("min_raw", T.DoubleType()),
                              T.StructField("max_raw", T.DoubleType())])


def write_bounds(bounds: DataFrame, path: str) -> None:
    """S15 sink: a one-row parquet table."""
    bounds.coalesce(1).write.mode("overwrite").parquet(path)


def read_bounds(spark: SparkSession, path: str | None) -> DataFrame:
    """S15 source: stored bounds, or the default (0, 5) when there are none; any other read error is raised."""
    default = spark.createDataFrame([R.DEFAULT_BOUNDS], BOUNDS_SCHEMA)
    if not path:
        return default
    try:
        stored = spark.read.schema(BOUNDS_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return default
        raise
    return stored.select(F.coalesce("min_raw", F.lit(R.DEFAULT_BOUNDS[0])).alias("min_raw"),
                         F.coalesce("max_raw", F.lit(R.DEFAULT_BOUNDS[1])).alias("max_raw"))


def score_with_bounds(df: DataFrame, bounds: DataFrame | tuple[float, float] = R.DEFAULT_BOUNDS,
                      out: str = "tsi") -> DataFrame:
    """Normalise by stored bounds.

    A bounds DataFrame (one row) is applied as scalar subqueries, planned as a
    separate tiny job whose values are inlined, so no join is needed.
    """
    if isinstance(bounds, tuple):
        mn, mx = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    else:
        mn = bounds.select(F.first("min_raw")).scalar()
        mx = bounds.select(F.first("max_raw")).scalar()
    return df.withColumn(out, normalise(raw_severity_expr(df), mn, mx))


def score_self_normalised(df: DataFrame, out: str = "tsi") -> DataFrame:
    """Normalise by this data's own min/max (one global aggregate)."""
    return score_with_bounds(df, calibration_bounds(df), out)


def single_score(nkill, nwound, success=1.0, claimed=0.0,
                 bounds: tuple[float, float] = R.DEFAULT_BOUNDS) -> Column:
    """T4: one incident's score from scalar columns or literals (no NULL coercion)."""
    def c(v):
        return v if isinstance(v, Column) else F.lit(float(v))
    raw = (F.lit(R.W_KILL) * F.log1p(F.greatest(c(nkill), F.lit(0.0)))
           + F.lit(R.W_WOUND) * F.log1p(F.greatest(c(nwound), F.lit(0.0)))
           + F.lit(R.W_SUCCESS) * F.least(F.greatest(c(success), F.lit(0.0)), F.lit(1.0))
           + F.lit(R.W_CLAIMED) * F.least(F.greatest(c(claimed), F.lit(0.0)), F.lit(1.0)))
    return normalise(raw, F.lit(float(bounds[0])), F.lit(float(bounds[1])))


def severity_label(score: Column | str) -> Column:
    """T5: >=75 CRITICAL, >=50 HIGH, >=25 MEDIUM, else LOW."""
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for cut, label in R.SEVERITY_LABELS:
        expr = F.when(s >= cut, label) if expr is None else expr.when(s >= cut, label)
    return expr.otherwise("LOW")


def power_law_score(df: DataFrame, out: str = "tsi_power") -> DataFrame:
    """The documented score ((3 kill + wound) ^ .85, x1.0 success / x0.4 failure)."""
    p = R.POWER_LAW
    impact = F.lit(p["kill_weight"]) * nonneg("nkill") + F.lit(p["wound_weight"]) * nonneg("nwound")
    mult = F.when(flag01("success") >= 1, F.lit(p["success_multiplier"])).otherwise(
        F.lit(p["fail_multiplier"]))
    return df.withColumn(out, F.pow(impact, F.lit(p["exponent"])) * mult)
