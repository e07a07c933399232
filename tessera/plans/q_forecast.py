"""ARIMA queries (F4, F5, F6, F7, F9, F10) with DuckDB oracles (recursive walks over the years)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions.expr import round_even
from tessera.operators import forecast
from tessera.plans.q_series import SERIES_CTES, hotspot_series
from tessera.plans.registry import query
from tessera.session import materialize

_ORDERS = ", ".join(f"({i}, {p}, {d}, {q})" for i, (p, d, q) in enumerate(R.ARIMA_ORDERS))


def _walk(name: str, source: str) -> str:
    """Sums of every (series, order, theta) of ``source`` (cluster, y, n, seq, p, d, q, theta)."""
    w = "(y[t + 2] - CASE WHEN d = 1 THEN y[t + 1] ELSE 0 END)"
    step = f"({w} - theta * u)"
    return f"""
{name}_r AS (SELECT *, 0 AS t, CASE WHEN d = 1 THEN 0.0::DOUBLE ELSE y[1] END AS u, 0.0::DOUBLE AS u1, 0.0::DOUBLE AS u2, 0.0::DOUBLE AS s00,
    0.0::DOUBLE AS s01, 0.0::DOUBLE AS s02, 0.0::DOUBLE AS s11, 0.0::DOUBLE AS s12, 0.0::DOUBLE AS s22 FROM {source}
  UNION ALL SELECT cluster, y, n, seq, p, d, q, theta, t + 1, {step}, u, u1, s00 + {step} * {step}, s01 + {step} * u, s02 + {step} * u1,
    s11 + u * u, s12 + u * u1, s22 + u1 * u1 FROM {name}_r WHERE t + 1 < n),
{name}_f AS (SELECT *, {forecast.SSE.replace('s.', '')} AS sse, {forecast.PHI1.replace('s.', '')} AS phi1,
  {forecast.PHI2.replace('s.', '')} AS phi2 FROM {name}_r WHERE t = n - 1)"""


def _fit(name: str, source: str) -> str:
    """Grid search, refinement and the fit of every (series, order) of ``source`` (cluster, y, n, seq, p, d, q)."""
    return f"""
{name}_g AS (SELECT s.*, unnest(CASE WHEN q = 1 THEN list_transform(range({forecast.GRID}), lambda i: (i - 19) * 0.05::DOUBLE)
  ELSE [0.0::DOUBLE] END) AS theta FROM {source} s),
{_walk(name + '_1', name + '_g')},
{name}_b AS (SELECT cluster, seq, arg_min(theta, (sse, theta)) AS theta FROM {name}_1_f GROUP BY ALL),
{name}_h AS (SELECT s.*, unnest(CASE WHEN q = 1 THEN list_transform(range({forecast.FINE}), lambda i:
  greatest(-0.99::DOUBLE, least(0.99::DOUBLE, b.theta + (i - 10) * 0.005::DOUBLE))) ELSE [0.0::DOUBLE] END) AS theta
  FROM {source} s JOIN {name}_b b USING (cluster, seq)),
{_walk(name + '_2', name + '_h')},
{name} AS (SELECT * EXCLUDE (rn), sse / (n - 1) AS sigma2, (n - 1) * ln(sse / (n - 1)) + 2 * (p + q + 1) AS aic FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster, seq ORDER BY sse, theta) AS rn FROM {name}_2_f) z WHERE rn = 1)"""


def _path(name: str, fits: str, steps: str) -> str:
    """Means and variances of ``steps`` years after each fit."""
    wt = lambda i: f"(y[{i}] - CASE WHEN d = 1 THEN coalesce(y[{i} - 1], y[{i}]) ELSE 0 END)"
    v = "(phi1 * v1 + phi2 * v2 + CASE WHEN h = 0 THEN theta * e ELSE 0 END)"
    psi = "(CASE WHEN h = 0 THEN 1 ELSE phi1 * p1 + phi2 * p2 + CASE WHEN h = 1 THEN theta ELSE 0 END END)"
    return f"""
{name}_r AS (SELECT cluster, d, phi1, phi2, theta, sigma2, {steps} AS steps, u - phi1 * u1 - phi2 * u2 AS e, 0 AS h, {wt('n')} AS v1,
    {wt('(n - 1)')} AS v2, y[n] AS level, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS ps, 0.0::DOUBLE AS sq FROM {fits}
  UNION ALL SELECT cluster, d, phi1, phi2, theta, sigma2, steps, e, h + 1, {v}, v1, level + {v}, {psi}, p1, ps + {psi},
    sq + pow(CASE WHEN d = 1 THEN ps ELSE 0 END + {psi}, 2) FROM {name}_r WHERE h < steps),
{name} AS (SELECT cluster, h, CASE WHEN d = 1 THEN level ELSE v1 END AS mean, sigma2 * sq AS var FROM {name}_r WHERE h > 0)"""


_ORDER_CTES = SERIES_CTES + f""",
ords(seq, p, d, q) AS (VALUES {_ORDERS}),
trn AS (SELECT cluster, list(value ORDER BY iyear) AS y, count(*) AS n FROM spl2 WHERE NOT is_test GROUP BY cluster HAVING count(*) >= 2),
cands AS (SELECT cluster, y, n, seq, p, d, q FROM trn, ords),{_fit('fits', 'cands')},
best AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY aic, seq) AS rk FROM fits) z WHERE rk = 1),
ends AS (SELECT cluster, max(n_test) AS n_test, max(y1) AS y1 FROM spl2 GROUP BY cluster),
bestn AS (SELECT b.*, e.n_test FROM best b JOIN ends e USING (cluster)),{_path('hpath', 'bestn', 'n_test')},
held AS (SELECT h.cluster, h.iyear, h.actual, coalesce(p.mean, h.lr_pred) AS arima_pred, h.lr_pred FROM hold h
  JOIN ends e USING (cluster) LEFT JOIN hpath p ON p.cluster = h.cluster AND e.y1 - e.n_test + p.h = h.iyear)"""

_FUTURE_CTES = _ORDER_CTES + f""",
whole AS (SELECT s.cluster, list(s.value ORDER BY s.iyear) AS y, count(*) AS n FROM ser s GROUP BY s.cluster HAVING count(*) >= 2),
wcand AS (SELECT w.cluster, w.y, w.n, 0 AS seq, coalesce(b.p, 0) AS p, coalesce(b.d, 1) AS d, coalesce(b.q, 0) AS q
  FROM whole w LEFT JOIN best b USING (cluster)),{_fit('wfit', 'wcand')},{_path('wpath', 'wfit', '5')},
future AS (SELECT p.cluster, CAST(e.y1 + p.h AS INT) AS iyear, greatest(mean, 0.0) AS forecast,
  greatest(mean - {R.Z80} * sqrt(var), 0.0) AS lo80, greatest(mean + {R.Z80} * sqrt(var), 0.0) AS hi80,
  greatest(mean - {R.Z95} * sqrt(var), 0.0) AS lo95, greatest(mean + {R.Z95} * sqrt(var), 0.0) AS hi95, 'arima' AS model
  FROM wpath p JOIN ends e USING (cluster))"""
_BANDS = ["forecast", "lo80", "hi80", "lo95", "hi95"]
_R = lambda cols: ", ".join(f"round_even({c}, 6) AS {c}" for c in cols)


def _rounded(df, *cols):
    return df.withColumns({c: round_even(c, 6) for c in cols})


@query("f4_arima_order_selection", oracle=_ORDER_CTES + """
SELECT e.cluster, coalesce(p, 0) AS p, coalesce(d, 1) AS d, coalesce(q, 0) AS q, round_even(aic, 6) AS aic, round_even(theta, 6) AS theta
FROM ends e LEFT JOIN best b USING (cluster)""")
def f4_arima_order_selection(spark):
    return _rounded(forecast.holdout(hotspot_series(spark))[0], "aic", "theta")


@query("f5_arima_holdout_forecast", oracle=_ORDER_CTES + f"\nSELECT cluster, iyear, {_R(['actual', 'arima_pred', 'lr_pred'])} FROM held")
def f5_arima_holdout_forecast(spark):
    return _rounded(forecast.holdout(hotspot_series(spark))[1], "actual", "arima_pred", "lr_pred")


@query("f6_arima_error_metrics", oracle=_ORDER_CTES + """,
e2 AS (SELECT cluster, 'arima' AS model, actual - arima_pred AS err FROM held UNION ALL SELECT cluster, 'trend', actual - lr_pred FROM held)
SELECT cluster, model, round_even(sqrt(avg(err * err)), 6) AS rmse, round_even(avg(abs(err)), 6) AS mae FROM e2 GROUP BY ALL""")
def f6_arima_error_metrics(spark):
    return _rounded(forecast.holdout_errors(forecast.holdout(hotspot_series(spark))[1]), "rmse", "mae")


@query("f7_arima_forecast_intervals", bench=True, oracle=_FUTURE_CTES + f"\nSELECT cluster, iyear, {_R(_BANDS)}, model FROM future")
def f7_arima_forecast_intervals(spark):
    return _rounded(forecast.forecasts(hotspot_series(spark)), *_BANDS)


# The fixture has seven years: the last three are predicted from four (the operator's defaults are
# 2014 and five years).
_TEST, _MIN_TRAIN = 3, 4


@query("f9_hotspot_backtest", oracle=SERIES_CTES + f""",
top3 AS (SELECT cluster FROM ranked WHERE rank <= 3),
cut AS (SELECT max(iyear) - {_TEST} AS c FROM ser),
ords(seq, p, d, q) AS (VALUES {_ORDERS}),
tst AS (SELECT s.cluster, s.iyear, s.value FROM ser s JOIN top3 USING (cluster), cut WHERE s.iyear > c AND s.iyear <= c + {_TEST}),
trn AS (SELECT cluster, list(value ORDER BY iyear) AS y, count(*) AS n FROM ser JOIN top3 USING (cluster), cut WHERE iyear <= c
  GROUP BY cluster HAVING count(*) >= {_MIN_TRAIN}),
cands AS (SELECT cluster, y, n, seq, p, d, q FROM trn, ords WHERE cluster IN (SELECT cluster FROM tst GROUP BY cluster HAVING count(*) >= {_TEST})),
{_fit('fits', 'cands')},
best AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY aic, seq) AS rk FROM fits) z WHERE rk = 1),
{_path('bpath', 'best', str(_TEST))},
er AS (SELECT t.cluster, t.value, abs(t.value - greatest(p.mean, 0.0)) AS err FROM tst t, cut JOIN bpath p ON p.cluster = t.cluster AND c + p.h = t.iyear)
SELECT b.cluster, b.p, b.d, b.q, round_even(avg(err), 6) AS mae, round_even(avg(err / greatest(value, 1.0)) * 100, 6) AS mape
FROM er JOIN best b ON b.cluster = er.cluster GROUP BY ALL""")
def f9_hotspot_backtest(spark):
    """F9 on the three hotspots with the highest total severity; the last three years are predicted."""
    from tessera.operators import series
    from tessera.plans.q_spatial import hotspots
    _, clustered, summary = hotspots(spark)
    top = summary.filter("rank <= 3").select("cluster")
    every = materialize(series.yearly_series(clustered.filter("cluster >= 0"), "cluster", "tsi"), "backtest-series")
    last = every.agg(F.max("iyear")).first()[0] or 0
    b = forecast.backtest(every.join(top, "cluster", "left_semi"), cutoff=last - _TEST, test_years=_TEST, min_train=_MIN_TRAIN)
    return _rounded(b, "mae", "mape")


@query("f10_interval_widths", oracle=_FUTURE_CTES + """
SELECT f.cluster, r.rank, round_even(avg(hi80 - lo80), 6) AS width80, round_even(avg(hi95 - lo95), 6) AS width95
FROM future f JOIN ranked r USING (cluster) WHERE r.rank <= 3 GROUP BY f.cluster, r.rank""")
def f10_interval_widths(spark):
    from tessera.plans.q_spatial import hotspots
    _, _, summary = hotspots(spark)
    return _rounded(forecast.interval_widths(forecast.forecasts(hotspot_series(spark)), summary, "cluster", 3), "width80", "width95")
