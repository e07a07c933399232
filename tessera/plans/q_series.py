"""Time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.expr import round_even
from tessera.operators import series
from tessera.operators.prep import scored_incidents
from tessera.plans.registry import query
from tessera.plans.sqlparts import SCORED_INCIDENTS_CTE
from tessera.session import materialize


@query("f11_country_year_totals", bench=True, oracle=f"""
WITH {SCORED_INCIDENTS_CTE}
SELECT country_txt, iyear, count(*) AS attacks, round_even(sum(nkill), 6) AS fatalities,
  round_even(sum(nwound), 6) AS injuries, round_even(sum(tsi), 6) AS total_tsi
FROM scored GROUP BY country_txt, iyear""")
def f11_country_year_totals(spark):
    return series.country_year_totals(scored_incidents(spark))


# ---- hotspot yearly series (F1-F3, F6, F8) --------------------------------------------

def hotspot_series(spark, value: str = "tsi"):
    from tessera.plans.q_spatial import hotspots
    _, clustered, _ = hotspots(spark)
    # written once: splits, fits and spans read it several times
    return materialize(series.yearly_series(clustered.filter(F.col("cluster") >= 0), "cluster", value), "hotspot-series")


def _series_ctes() -> str:
    from tessera.plans.q_spatial import HOT_CTES
    return HOT_CTES + """,
yr AS (SELECT cluster, iyear, sum(tsi) AS v FROM members GROUP BY cluster, iyear),
sp AS (SELECT cluster, min(iyear) AS y0, max(iyear) AS y1 FROM yr GROUP BY cluster),
yrs AS (SELECT cluster, CAST(unnest(generate_series(y0, y1)) AS INT) AS iyear FROM sp),
ser AS (SELECT y.cluster, y.iyear, coalesce(yr.v, 0.0) AS value FROM yrs y
  LEFT JOIN yr ON yr.cluster = y.cluster AND yr.iyear = y.iyear),
spn AS (SELECT cluster, min(iyear) AS y0, max(iyear) AS y1, count(*) AS n FROM ser GROUP BY cluster),
spl AS (SELECT s.*, p.y0, p.y1, p.n, least(3, greatest(1, CAST(floor(p.n / 3) AS INT))) AS n_test,
  s.iyear - p.y0 AS t FROM ser s JOIN spn p USING (cluster)),
spl2 AS (SELECT *, iyear > y1 - n_test AS is_test FROM spl),
fit AS (SELECT cluster, CASE WHEN count(*) >= 2 THEN regr_slope(value, t) ELSE 0.0 END AS slope,
  avg(value) AS my, avg(t) AS mt FROM spl2 WHERE NOT is_test GROUP BY cluster),
hold AS (SELECT s.cluster, s.iyear, s.value AS actual,
  greatest((f.my - f.slope * f.mt) + f.slope * s.t, 0.0) AS lr_pred FROM spl2 s JOIN fit f USING (cluster)
  WHERE s.is_test)"""


SERIES_CTES = _series_ctes()


@query("f1_hotspot_yearly_series", oracle=_series_ctes() + """
SELECT cluster, iyear, round_even(value, 6) AS value FROM ser""")
def f1_hotspot_yearly_series(spark):
    return hotspot_series(spark).withColumn("value", round_even("value", 6))


@query("f2_holdout_split", oracle=_series_ctes() + """
SELECT cluster, iyear, round_even(value, 6) AS value, n_test, is_test FROM spl2""")
def f2_holdout_split(spark):
    s = series.holdout_split(hotspot_series(spark))
    return s.select("cluster", "iyear", round_even("value", 6).alias("value"), "n_test", "is_test")


@query("f3_trend_holdout", oracle=_series_ctes() + """
SELECT cluster, iyear, round_even(actual, 6) AS actual, round_even(lr_pred, 6) AS lr_pred FROM hold""")
def f3_trend_holdout(spark):
    h = series.trend_holdout(hotspot_series(spark))
    return h.withColumns({"actual": round_even("actual", 6), "lr_pred": round_even("lr_pred", 6)})


@query("f6_trend_error_metrics", oracle=_series_ctes() + """
SELECT cluster, round_even(sqrt(avg((actual - lr_pred) * (actual - lr_pred))), 6) AS rmse,
  round_even(avg(abs(actual - lr_pred)), 6) AS mae FROM hold GROUP BY cluster""")
def f6_trend_error_metrics(spark):
    m = series.error_metrics(series.trend_holdout(hotspot_series(spark)))
    return m.withColumns({"rmse": round_even("rmse", 6), "mae": round_even("mae", 6)})


@query("f8_trend_fallback_forecast", oracle=_series_ctes() + """,
ffit AS (SELECT cluster, CASE WHEN count(*) >= 2 THEN regr_slope(value, t) ELSE 0.0 END AS slope,
  avg(value) AS my, avg(t) AS mt, max(iyear) AS y1, count(*) AS n FROM spl2 GROUP BY cluster),
fc AS (SELECT cluster, CAST(y1 + h AS INT) AS iyear,
  greatest((my - slope * mt) + slope * (n + h - 1), 0.0) AS forecast
  FROM ffit, (SELECT unnest(generate_series(1, 5)) AS h) hs)
SELECT cluster, iyear, round_even(forecast, 6) AS forecast, round_even(forecast * 0.8, 6) AS lo80,
  round_even(forecast * 1.2, 6) AS hi80, round_even(forecast * 0.6, 6) AS lo95,
  round_even(forecast * 1.4, 6) AS hi95 FROM fc""")
def f8_trend_fallback_forecast(spark):
    f = series.trend_forecast(hotspot_series(spark))
    return f.withColumns({c: round_even(c, 6) for c in ["forecast", "lo80", "hi80", "lo95", "hi95"]})


@query("f12_timeline_yoy", oracle=f"""
WITH {SCORED_INCIDENTS_CTE},
y AS (SELECT iyear, count(*) AS incidents, sum(nkill) AS fatalities FROM scored
  WHERE iyear IS NOT NULL GROUP BY iyear)
SELECT iyear, incidents, round_even(fatalities, 6) AS fatalities,
  lag(incidents) OVER (ORDER BY iyear) AS prev_incidents,
  round_even(CASE WHEN lag(incidents) OVER (ORDER BY iyear) > 0 THEN (incidents - lag(incidents) OVER (ORDER BY iyear))
    / lag(incidents) OVER (ORDER BY iyear) * 100 END, 6) AS yoy_change_pct FROM y""")
def f12_timeline_yoy(spark):
    t = series.timeline(scored_incidents(spark))
    return t.withColumns({"fatalities": round_even("fatalities", 6),
                          "yoy_change_pct": round_even("yoy_change_pct", 6)})
