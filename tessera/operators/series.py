"""Yearly series, hold-out splits, linear trend and period comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import round_even


def country_year_totals(df: DataFrame) -> DataFrame:
    """attacks, fatalities, injuries and severity per country and year."""
    return (df.groupBy("country_txt", "iyear")
            .agg(F.count(F.lit(1)).alias("attacks"),
                 round_even(F.sum("nkill"), 6).alias("fatalities"),
                 round_even(F.sum("nwound"), 6).alias("injuries"),
                 round_even(F.sum("tsi"), 6).alias("total_tsi")))


def yearly_series(df: DataFrame, key: str = "cluster", value: str = "tsi") -> DataFrame:
    """per-key yearly sum of ``value`` (or row count when value == 'count'),
    zero-filled between that key's own first and last year."""
    v = F.count(F.lit(1)).cast("double") if value == "count" else F.sum(value).cast("double")
    yearly = df.groupBy(key, "iyear").agg(v.alias("value"))
    span = yearly.groupBy(key).agg(F.min("iyear").alias("y0"), F.max("iyear").alias("y1"))
    years = span.select(key, F.explode(F.sequence("y0", "y1")).alias("iyear"))
    return (years.join(yearly, [key, "iyear"], "left")
            .withColumn("value", F.coalesce("value", F.lit(0.0))))


def holdout_split(series: DataFrame, key: str = "cluster", test_years: int = 3) -> DataFrame:
    """test = min(test_years, max(1, n div 3)) last years of each series."""
    span = series.groupBy(key).agg(F.min("iyear").alias("y0"), F.max("iyear").alias("y1"),
                                   F.count(F.lit(1)).alias("n"))
    span = span.withColumn("n_test", F.least(F.lit(test_years),
                                             F.greatest(F.lit(1), F.floor(F.col("n") / 3).cast("int"))))
    return (series.join(span, key)
            .withColumn("t", F.col("iyear") - F.col("y0"))
            .withColumn("is_test", F.col("iyear") > F.col("y1") - F.col("n_test")))


def trend_fit(split: DataFrame, key: str = "cluster", train_only: bool = True) -> DataFrame:
    """least-squares line on t = 0..n-1 (one point -> flat line through it)."""
    rows = split.filter(~F.col("is_test")) if train_only else split
    fit = rows.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.avg("t").alias("mt"),
                                F.avg("value").alias("my"),
                                F.regr_slope("value", "t").alias("slope_raw"))
    slope = F.when(F.col("m") >= 2, F.col("slope_raw")).otherwise(F.lit(0.0))
    return fit.select(key, slope.alias("slope"), (F.col("my") - slope * F.col("mt")).alias("intercept"))


def trend_holdout(series: DataFrame, key: str = "cluster", test_years: int = 3) -> DataFrame:
    """F3 on the hold-out years: predictions clipped at 0."""
    split = holdout_split(series, key, test_years)
    fit = trend_fit(split, key)
    return (split.filter("is_test").join(fit, key)
            .select(key, "iyear", F.col("value").alias("actual"),
                    F.greatest(F.col("intercept") + F.col("slope") * F.col("t"), F.lit(0.0)).alias("lr_pred")))


def error_metrics(pred: DataFrame, key: str = "cluster", actual: str = "actual",
                  predicted: str = "lr_pred") -> DataFrame:
    """RMSE and MAE per series."""
    err = F.col(actual) - F.col(predicted)
    return pred.groupBy(key).agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"))


def trend_forecast(series: DataFrame, key: str = "cluster", horizon: int = 5) -> DataFrame:
    """F8: the fallback forecast — trend on all years, clipped, +-20 % and +-40 % bands."""
    split = holdout_split(series, key).withColumn("is_test", F.lit(False))
    fit = trend_fit(split, key, train_only=False)
    span = split.groupBy(key).agg(F.max("iyear").alias("y1"), F.count(F.lit(1)).alias("n"))
    fut = span.select(key, "y1", "n", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    m = F.greatest(F.col("intercept") + F.col("slope") * (F.col("n") + F.col("h") - 1), F.lit(0.0))
    return (fut.join(fit, key).select(
        key, (F.col("y1") + F.col("h")).cast("int").alias("iyear"), m.alias("forecast"))
        .withColumns({"lo80": F.col("forecast") * 0.8, "hi80": F.col("forecast") * 1.2,
                      "lo95": F.col("forecast") * 0.6, "hi95": F.col("forecast") * 1.4}))


def timeline(df: DataFrame, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """yearly incidents and fatalities (in a year range, if given) with year-over-year change.

    ``lag`` runs over the yearly aggregate (one row per year), never over rows.
    """
    year = F.col("iyear")
    yearly = (df.filter((year >= (year if year_min is None else F.lit(year_min))) & (year <= (year if year_max is None else F.lit(year_max))))
              .groupBy("iyear")
              .agg(F.count(F.lit(1)).alias("incidents"), F.sum("nkill").alias("fatalities")))
    prev = F.lag("incidents").over(Window.orderBy("iyear"))
    return (yearly.withColumn("prev_incidents", prev)
            .withColumn("yoy_change_pct", F.when(F.col("prev_incidents") > 0,
                                                 (F.col("incidents") - F.col("prev_incidents"))
                                                 / F.col("prev_incidents") * 100)))
