"""ARIMA order selection, hold-out validation and forecasts for every series.

Each series is one row with its yearly values as an array (bounded by the span of years), and
everything is column expressions over rows of (series, order): no Python runs in the tasks.

The fit is conditional least squares with zeros before the first value.  With u_t = w_t - theta
u_{t-1} the residuals are linear in the AR coefficients, so these follow from running sums of u
(normal equations); theta is searched on a grid in (-1, 1), then refined around the best.  All nine
orders are tried on every series with two values or more, and all are judged on the same points,
the second to the last, so their AIC can be compared.  The reference uses exact state-space
likelihood, so chosen orders and interval widths can differ; the candidate orders, the AIC rule
(first wins ties), the hold-out rule, clipping and the linear-trend fallback are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.operators import series as S
from tessera.session import materialize

GRID, FINE = 39, 21                       # values of theta: -0.95, -0.90, ..., then 0.005 apart
FLOOR = 1e-9                              # of the series' own sum of squares

# One value w_t of the series (differenced where d = 1) at the 0-based place t.
_W = "(get(y, {t}) - if(d = 1, coalesce(get(y, {t} - 1), get(y, {t})), 0D))"
_STEP = "(" + _W.format(t="t") + " - {th} * a.u)"
# Running sums of u_t with its two predecessors, t = 1 .. n-1.
_SUMS = """aggregate(sequence(1, n - 1),
  named_struct('u', """ + _W.format(t="0") + """, 'u1', 0D, 'u2', 0D, 's00', 0D, 's01', 0D, 's02', 0D, 's11', 0D, 's12', 0D, 's22', 0D),
  (a, t) -> named_struct('u', {step}, 'u1', a.u, 'u2', a.u1, 's00', a.s00 + {step} * {step}, 's01', a.s01 + {step} * a.u,
    's02', a.s02 + {step} * a.u1, 's11', a.s11 + a.u * a.u, 's12', a.s12 + a.u * a.u1, 's22', a.s22 + a.u1 * a.u1))"""
# AR coefficients from the sums s (in place of a singular pair, the first alone).
_DET = "(s.s11 * s.s22 - s.s12 * s.s12)"
_PAIR = f"(p = 2 AND {_DET} > 1e-12 * s.s11 * s.s22)"
PHI1 = f"CASE WHEN {_PAIR} THEN (s.s01 * s.s22 - s.s02 * s.s12) / {_DET} WHEN p >= 1 AND s.s11 > 0 THEN s.s01 / s.s11 ELSE 0 END"
PHI2 = f"CASE WHEN {_PAIR} THEN (s.s02 * s.s11 - s.s01 * s.s12) / {_DET} ELSE 0 END"
SSE = f"greatest(s.s00 - ({PHI1}) * s.s01 - ({PHI2}) * s.s02, {FLOOR} * s.s00, 1e-12)"


def _sums(theta: str) -> str:
    return _SUMS.format(step=_STEP.format(th=theta))


def _once(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once and bound to ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _best_theta(thetas: str) -> str:
    """The theta of least squared error in an array of them (the smallest of equal ones)."""
    return (f"array_min(transform({thetas}, th -> " + _once(_sums("th"), "s", f"named_struct('sse', CAST({SSE} AS DOUBLE), 'th', th)") + ")).th")


_GRID = f"if(q = 1, transform(sequence(0, {GRID - 1}), i -> (i - 19) * 0.05D), array(0D))"
_FINE = f"if(q = 1, transform(sequence(0, {FINE - 1}), i -> greatest(-0.99D, least(0.99D, t0 + (i - 10) * 0.005D))), array(0D))"
_FIT = _once(_best_theta(_GRID), "t0", _once(_best_theta(_FINE), "t1", _once(
    _sums("t1"), "s", f"named_struct('theta', t1, 'phi1', CAST({PHI1} AS DOUBLE), 'phi2', CAST({PHI2} AS DOUBLE), 'sse', CAST({SSE} AS DOUBLE), 's', s)")))


def fit_orders(rows: DataFrame) -> DataFrame:
    """``rows`` (key.., y, n, p, d, q) with theta, phi1, phi2, sigma2, aic and the last u's (struct s).

    Written once: a fit is the dear part, and what follows reads its columns several times."""
    out = materialize(rows.withColumn("fit", F.expr(_FIT)), "arima-fits").select(*rows.columns, "fit.*")
    out = out.withColumn("sigma2", F.col("sse") / (F.col("n") - 1)).drop("sse")
    return out.withColumn("aic", (F.col("n") - 1) * F.log("sigma2") + 2 * (F.col("p") + F.col("q") + 1))


def select_order(arrays: DataFrame, key: str) -> DataFrame:
    """of the nine orders the one with the lowest AIC, first wins ties; (key, y, n) with n >= 2."""
    orders = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q"))
                       for i, (p, d, q) in enumerate(R.ARIMA_ORDERS)])
    fits = fit_orders(arrays.filter("n >= 2").select(key, "y", "n", F.explode(orders).alias("o")).select(key, "y", "n", "o.*"))
    best = F.min(F.struct("aic", "seq", "p", "d", "q", "theta", "phi1", "phi2", "sigma2", "s", "y", "n"))
    return fits.groupBy(key).agg(best.alias("m")).select(key, "m.*")


# State after h steps: the last two values of w, the level, the last two psi weights, their sum and the
# sum of squared error weights.
_V = "(phi1 * a.v1 + phi2 * a.v2 + if(h = 1, theta * e, 0D))"
_PSI = "if(h = 1, 1D, phi1 * a.p1 + phi2 * a.p2 + if(h = 2, theta, 0D))"
_NEXT = f"""named_struct('v1', {_V}, 'v2', a.v1, 'level', a.level + {_V}, 'p1', {_PSI}, 'p2', a.p1, 'ps', a.ps + {_PSI},
  'sq', a.sq + power(if(d = 1, a.ps, 0D) + {_PSI}, 2))"""


def forecast(fits: DataFrame, steps: str, key: str) -> DataFrame:
    """(key, h, mean, var) for h = 1 .. ``steps`` (a SQL expression over the fit's row)."""
    start = ("named_struct('v1', " + _W.format(t="n - 1") + ", 'v2', if(n >= 2, " + _W.format(t="n - 2")
             + ", 0D), 'level', get(y, n - 1), 'p1', 0D, 'p2', 0D, 'ps', 0D, 'sq', 0D)")
    rows = fits.withColumn("e", F.expr("s.u - phi1 * s.u1 - phi2 * s.u2"))
    rows = rows.withColumn("path", F.expr(
        f"slice(aggregate(sequence(1, {steps}), array({start}), (l, h) -> "
        f"concat(l, transform(array(element_at(l, -1)), a -> {_NEXT}))), 2, {steps})"))
    return (rows.select(key, "d", "sigma2", F.posexplode("path").alias("h", "f"))
            .select(key, (F.col("h") + 1).alias("h"), F.when(F.col("d") == 1, F.col("f.level")).otherwise(F.col("f.v1")).alias("mean"),
                    (F.col("sigma2") * F.col("f.sq")).alias("var")))


def as_arrays(rows: DataFrame, key: str) -> DataFrame:
    """(key, y, n): the values of (key, iyear, value) in year order; a series has a value for each year."""
    pairs = F.array_sort(F.collect_list(F.struct("iyear", F.col("value").cast("double").alias("value"))))
    return (rows.groupBy(key).agg(pairs.alias("v"))
            .select(key, F.transform("v", lambda x: x["value"]).alias("y"), F.size("v").alias("n")))


def holdout(series: DataFrame, key: str = "cluster", test_years: int = 3) -> tuple[DataFrame, DataFrame]:
    """F4 + F5: the order of each series' training years, and its predictions of the years held out.

    Series with one training year get order (0, 1, 0) and the trend's predictions; those with none have
    no predictions.
    """
    split = materialize(S.holdout_split(series, key, test_years), "forecast-split")
    train = as_arrays(split.filter(~F.col("is_test")), key)
    fits = materialize(select_order(train, key), "forecast-orders")
    spans = split.groupBy(key).agg(F.max("n_test").alias("n_test"), (F.max("y1") - F.max("n_test")).alias("last"))
    steps = forecast(fits.join(spans, key), "n_test", key).join(spans, key)
    arima = steps.select(key, (F.col("last") + F.col("h")).alias("iyear"), F.col("mean").alias("arima"))
    trend = S.trend_holdout(series, key, test_years)
    held = (trend.join(arima, [key, "iyear"], "left")
            .select(key, "iyear", "actual", F.coalesce("arima", "lr_pred").alias("arima_pred"), "lr_pred"))
    orders = spans.select(key).join(fits, key, "left").select(
        key, F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("d", F.lit(1)).alias("d"), F.coalesce("q", F.lit(0)).alias("q"), "aic", "theta")
    return orders, held


def forecasts(series: DataFrame, key: str = "cluster", test_years: int = 3, horizon: int = 5) -> DataFrame:
    """F7 (F8 where no fit is possible): years after the last one with 80 % and 95 % intervals."""
    orders, _ = holdout(series, key, test_years)
    whole = as_arrays(series, key).filter("n >= 2").join(orders.select(key, "p", "d", "q"), key)
    last = series.groupBy(key).agg(F.max("iyear").alias("last"))
    path = forecast(fit_orders(whole), str(horizon), key).join(last, key)
    sd = F.sqrt("var")
    clip = lambda c: F.greatest(c, F.lit(0.0))
    arima = path.select(
        key, (F.col("last") + F.col("h")).alias("iyear"), clip(F.col("mean")).alias("forecast"),
        clip(F.col("mean") - R.Z80 * sd).alias("lo80"), clip(F.col("mean") + R.Z80 * sd).alias("hi80"),
        clip(F.col("mean") - R.Z95 * sd).alias("lo95"), clip(F.col("mean") + R.Z95 * sd).alias("hi95"), F.lit("arima").alias("model"))
    short = series.join(whole.select(key), key, "left_anti")
    return arima.unionByName(S.trend_forecast(short, key, horizon).withColumn("model", F.lit("trend")))


def holdout_errors(held: DataFrame, key: str = "cluster") -> DataFrame:
    """RMSE and MAE of both models on the years held out."""
    both = held.select(key, "actual", F.explode(F.array(
        F.struct(F.lit("arima").alias("model"), F.col("arima_pred").alias("pred")),
        F.struct(F.lit("trend").alias("model"), F.col("lr_pred").alias("pred")))).alias("m")).select(key, "actual", "m.*")
    err = F.col("actual") - F.col("pred")
    return both.groupBy(key, "model").agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"))


def backtest(series: DataFrame, key: str = "cluster", cutoff: int = 2014, test_years: int = 3, min_train: int = 5,
             min_test: int = 3) -> DataFrame:
    """train up to ``cutoff``, predict the ``test_years`` after it; MAE and MAPE (actuals below 1 count as 1).

    Series with fewer than ``min_train`` or ``min_test`` years are left out; where no order can be fitted
    (a single training year) the last value is carried on, which is order (0, 1, 0).
    """
    train = as_arrays(series.filter(F.col("iyear") <= cutoff), key).filter(F.col("n") >= min_train)
    test = series.filter((F.col("iyear") > cutoff) & (F.col("iyear") <= cutoff + test_years))
    full = test.groupBy(key).agg(F.count(F.lit(1)).alias("n_test")).filter(F.col("n_test") >= min_test)
    fits = materialize(select_order(train.join(full.select(key), key), key), "backtest-orders")
    path = forecast(fits, str(test_years), key).withColumn("iyear", F.col("h") + cutoff)
    still = train.filter("n < 2").select(key, F.get("y", F.lit(0)).alias("mean"), F.explode(F.sequence(F.lit(1), F.lit(test_years))).alias("h"))
    path = path.select(key, "iyear", "mean").unionByName(still.select(key, (F.col("h") + cutoff).alias("iyear"), "mean"))
    err = F.abs(F.col("value") - F.greatest("mean", F.lit(0.0)))
    scores = test.join(full.select(key), key).join(path, [key, "iyear"]).groupBy(key).agg(
        F.avg(err).alias("mae"), (F.avg(err / F.greatest("value", F.lit(1.0))) * 100).alias("mape"))
    order = fits.select(key, "p", "d", "q")
    return scores.join(order, key, "left").select(key, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("p", 0), ("d", 1), ("q", 0))], "mae", "mape")


def interval_widths(future: DataFrame, ranked: DataFrame, key: str = "cluster", top: int = 3) -> DataFrame:
    """mean 80 % / 95 % interval width per top-``top`` hotspot."""
    f = future.join(ranked.filter(F.col("rank") <= top).select(key, "rank"), key)
    return f.groupBy(key, "rank").agg(F.avg(F.col("hi80") - F.col("lo80")).alias("width80"),
                                      F.avg(F.col("hi95") - F.col("lo95")).alias("width95"))
