"""DBSCAN against an independent plain-Python DBSCAN, hotspot summary, series and forecasts."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import cluster, forecast, series
from tessera.operators.prep import scored_incidents


def brute_dbscan(points, eps_km, min_samples):
    """Index-order DBSCAN (a point counts itself): cluster numbers by expansion order."""
    n = len(points)
    lat = np.radians([p[0] for p in points])
    lon = np.radians([p[1] for p in points])
    nb = []
    for i in range(n):
        a = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat) * np.sin((lon - lon[i]) / 2) ** 2
        d = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(a, 1.0)))
        nb.append(np.nonzero(d <= eps_km)[0])
    core = [len(x) >= min_samples for x in nb]
    labels = [-1] * n
    c = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if labels[j] != -1:
                continue
            labels[j] = c
            if core[j]:
                stack.extend(k for k in nb[j] if labels[k] == -1)
        c += 1
    return labels


def _sample(spark):
    rows = [(i, 12.0 + (y % 2) * 0.01, 77.0, float(y % 4), float(y % 3), 1, y, "Example")
            for i, y in enumerate(range(2000, 2020))]
    rows.append((20, 50.0, -120.0, 1.0, 0.0, 0, 2010, "Noise"))
    return spark.createDataFrame(rows, "incident_id long, latitude double, longitude double, nkill double, "
                                       "nwound double, success int, iyear int, country_txt string")


def test_single_hotspot_and_noise(spark):
    from tessera.operators import scoring
    df = scoring.score_with_bounds(_sample(spark))
    lab = cluster.dbscan(df, 5.0, 3)
    summary = cluster.hotspot_summary(df.join(lab, "incident_id")).collect()
    assert len(summary) == 1 and summary[0]["incidents"] == 20 and summary[0]["rank"] == 1
    assert lab.filter("cluster = -1").count() == 1


def test_border_point_takes_lowest_cluster(spark):
    # two blobs 9 km apart; the middle point is within eps of one point of each blob only
    rows = [(i, 0.0, -0.001 * i) for i in range(5)] + [(10 + i, 0.0, 0.0809 + 0.001 * i) for i in range(5)]
    rows.append((99, 0.0, 0.04045))
    df = spark.createDataFrame(rows, "incident_id long, latitude double, longitude double")
    lab = {r["incident_id"]: r["cluster"] for r in cluster.dbscan(df, 4.6, 5).collect()}
    assert lab[0] == 0 and lab[10] == 1 and lab[99] == 0


def test_antimeridian_and_pole(spark):
    rows = [(i, 10.0, 179.999 - 0.0005 * i) for i in range(4)] + [(10 + i, 10.0, -179.999 + 0.0005 * i) for i in range(4)]
    rows += [(20 + i, 89.999, 45.0 * i) for i in range(8)]
    df = spark.createDataFrame(rows, "incident_id long, latitude double, longitude double")
    lab = {r["incident_id"]: r["cluster"] for r in cluster.dbscan(df, 2.0, 3).collect()}
    assert lab[0] == lab[13] != -1
    assert len({lab[20 + i] for i in range(8)}) == 1 and lab[20] != -1


def test_dbscan_matches_brute_force(spark, small):
    inc = scored_incidents(spark)
    pts = inc.filter("latitude is not null").select("incident_id", "latitude", "longitude").orderBy("incident_id").collect()
    for eps, m in ((100.0, 15), (25.0, 5)):
        want = brute_dbscan([(p["latitude"], p["longitude"]) for p in pts], eps, m)
        got = {r["incident_id"]: r["cluster"] for r in cluster.dbscan(inc, eps, m).collect()}
        assert [got[p["incident_id"]] for p in pts] == want, (eps, m)


def test_yearly_gap_fill(spark):
    df = spark.createDataFrame([(0, 2000, 2.0), (0, 2002, 4.0)], "cluster int, iyear int, tsi double")
    got = {r["iyear"]: r["value"] for r in series.yearly_series(df).collect()}
    assert got == {2000: 2.0, 2001: 0.0, 2002: 4.0}


def _series(spark, *values):
    rows = [(k, 2000 + t, float(v)) for k, vs in enumerate(values) for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "cluster long, iyear int, value double")


def test_forecast_shapes(spark):
    s = _series(spark, [3, 4, 2, 5, 6, 4, 7, 8, 7, 9, 10, 11], [5, 6, 5, 7, 8, 8, 9, 11, 10, 12], [4.0], [1, 2])
    orders, held = forecast.holdout(s)
    assert {r["cluster"]: (r["p"], r["d"], r["q"]) for r in orders.collect()}.keys() == {0, 1, 2, 3}
    # a single year is held out and leaves nothing to train on
    assert {(r["cluster"], r["count"]) for r in held.groupBy("cluster").count().collect()} == {(0, 3), (1, 3), (3, 1)}
    errors = forecast.holdout_errors(held).collect()
    assert {r["model"] for r in errors} == {"arima", "trend"} and all(r["rmse"] >= r["mae"] >= 0 for r in errors)
    future = forecast.forecasts(s, horizon=4).collect()
    assert {(r["cluster"], r["iyear"]) for r in future} >= {(0, 2012), (0, 2015), (1, 2010), (2, 2001), (3, 2005)} and len(future) == 16
    assert all(0 <= r["lo95"] <= r["lo80"] <= r["forecast"] <= r["hi80"] <= r["hi95"] for r in future)
    assert {r["cluster"]: r["model"] for r in future} == {0: "arima", 1: "arima", 2: "trend", 3: "arima"}


def plain_css(y, p, d, q, theta):
    """The same sums with numpy: phi and squared error on the points 1 .. n-1."""
    w = np.array(y, float) if d == 0 else np.concatenate([[0.0], np.diff(y)])
    u = w.copy()
    for t in range(1, len(u)):
        u[t] = w[t] - theta * u[t - 1]
    lag = lambda k: np.concatenate([np.zeros(k), u[:-k]])[1:] if k else u[1:]
    x = np.stack([lag(k) for k in range(1, p + 1)], axis=1) if p else np.zeros((len(u) - 1, 0))
    phi = np.linalg.lstsq(x, lag(0), rcond=None)[0] if p else np.zeros(0)
    e = lag(0) - x @ phi
    return phi, float(e @ e)


def test_fits_against_numpy(spark):
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=25)) + 10
    rows = [(i, y.tolist(), 25, p, d, q) for i, (p, d, q) in enumerate([(1, 1, 1), (1, 1, 0), (0, 1, 1), (2, 1, 1), (1, 0, 1), (2, 1, 0), (0, 0, 0)])]
    fits = forecast.fit_orders(spark.createDataFrame(rows, "cluster int, y array<double>, n int, p int, d int, q int")).collect()
    for r in fits:
        phi, sse = plain_css(y, r["p"], r["d"], r["q"], r["theta"])
        assert np.allclose([r["phi1"], r["phi2"]][: len(phi)], phi) and abs(r["sigma2"] * 24 - sse) < 1e-6
        if r["q"]:
            grid = [plain_css(y, r["p"], r["d"], 1, t)[1] for t in np.linspace(-0.95, 0.95, 39)]
            assert sse <= min(grid) + 1e-9


def test_css_recovers_ar1(spark):
    rng = np.random.default_rng(7)
    w = np.zeros(400)
    for t in range(1, 400):
        w[t] = 0.6 * w[t - 1] + rng.normal()
    fit = forecast.fit_orders(spark.createDataFrame([(0, w.tolist(), 400, 1, 0, 0)], "cluster int, y array<double>, n int, p int, d int, q int"))
    assert abs(fit.first()["phi1"] - 0.6) < 0.1


def test_random_walk_intervals(spark):
    """Order (0, 1, 0): the last value is carried on and the variance grows by sigma2 each year."""
    fit = forecast.fit_orders(spark.createDataFrame([(0, [1.0, 3.0, 2.0, 6.0], 4, 0, 1, 0)], "cluster int, y array<double>, n int, p int, d int, q int"))
    got = forecast.forecast(fit, "3", "cluster").orderBy("h").collect()
    sigma2 = (4 + 1 + 16) / 3
    assert [r["mean"] for r in got] == [6.0] * 3 and np.allclose([r["var"] for r in got], [sigma2, 2 * sigma2, 3 * sigma2])


def test_backtest_rules(spark):
    s = _series(spark, [5, 6, 7, 8, 9, 10, 11, 12], [5, 6, 7, 8], [0, 0, 0, 0, 0, 0, 0, 0])
    got = {r["cluster"]: r for r in forecast.backtest(s, cutoff=2004).collect()}
    assert set(got) == {0, 2} and got[2]["mae"] == 0 and got[2]["mape"] == 0 and got[0]["mape"] < 20


def test_dense_box_is_not_all_pairs(spark):
    """Distinct points in one box of the size of eps: box pairs, point tests included, grow about linearly."""
    seen = {}
    real = cluster.materialize

    def counting(df, name):
        out = real(df, name)
        if name == "dbscan-box-pairs":
            seen[len(pts)] = seen.get(len(pts), 0) + out.count()
        return out

    cluster.materialize = counting
    try:
        rng = np.random.default_rng(1)
        for n in (2_000, 50_000):
            pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((n, 2)) * 0.8)]
            lab = cluster.dbscan(spark.createDataFrame(pts, "incident_id long, latitude double, longitude double"), 100.0, 15)
            assert lab.filter("cluster = 0").count() == n
    finally:
        cluster.materialize = real
    assert seen[50_000] <= 30 * max(seen[2_000], 50)


def test_separated_rings_need_the_finest_boxes(spark):
    """Two dense walls 10.2 km apart: far at eps 10 and near at eps 10.4, whatever lies behind them."""
    rng = np.random.default_rng(2)
    left = [(i, float(a) * 0.3, -float(b) * 0.05) for i, (a, b) in enumerate(rng.random((600, 2)))]
    right = [(1000 + i, float(a) * 0.3, 0.0917 + float(b) * 0.05) for i, (a, b) in enumerate(rng.random((600, 2)))]
    rows = left + right + [(5000, 0.15, 0.0), (5001, 0.15, 0.0917)]
    df = spark.createDataFrame(rows, "incident_id long, latitude double, longitude double")
    for eps, clusters in ((10.0, 2), (10.4, 1)):
        got = {r["incident_id"]: r["cluster"] for r in cluster.dbscan(df, eps, 5).collect()}
        assert [got[i] for i, _, _ in rows] == brute_dbscan([r[1:] for r in rows], eps, 5) and len(set(got.values())) == clusters


def test_light_points_beside_a_dense_cell(spark, monkeypatch):
    """15 light points around a cell of 100,000 points: only boxes on the border are opened."""
    rng = np.random.default_rng(12)
    eps = 100.0
    dense = rng.uniform([10.0, 20.0], [10.4, 20.4], (100_000, 2))
    around = [(10.2 + 1.05 * np.cos(a), 20.2 + 1.05 * np.sin(a)) for a in np.linspace(0, 6.2, 15)]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate([*around, *dense])]
    looked = []
    real = cluster.materialize

    def count(df, name):
        out = real(df, name)
        if name in ("dbscan-light-pairs", "dbscan-point-boxes", "dbscan-border-pairs"):
            looked.append(out.count())
        return out

    monkeypatch.setattr(cluster, "materialize", count)
    df = spark.createDataFrame(rows, "incident_id long, latitude double, longitude double")
    neighbours = [int((brute_km(r[1], r[2], dense) <= eps).sum()) for r in rows[:15]]
    assert 0 < sum(n > 0 for n in neighbours)
    least = sorted(neighbours)[7] + 1                     # some light points reach it, some don't
    lab = {r["incident_id"]: r["cluster"] for r in cluster.dbscan(df, eps, least).collect()}
    assert {lab[i] for i in range(15, len(rows))} == {0}
    assert [lab[i] for i in range(15)] == [0 if n else -1 for n in neighbours]
    assert 0 < sum(looked) < 100_000


def brute_km(lat, lon, points):
    a, b = np.radians(points[:, 0]), np.radians(points[:, 1])
    h = np.sin((a - np.radians(lat)) / 2) ** 2 + np.cos(a) * np.cos(np.radians(lat)) * np.sin((b - np.radians(lon)) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(h))


def test_box_counts_match_brute_force(spark, monkeypatch):
    """Every cell goes by boxes, down to single points."""
    monkeypatch.setattr(cluster, "FEW", 0)
    monkeypatch.setattr(cluster, "OPENED", 1)
    rng = np.random.default_rng(5)
    for eps, least, spread in ((20.0, 6, 1.0), (30.0, 40, 0.6)):
        pts = np.round(rng.normal([45.0, 7.0], spread, (300, 2)), 4)
        rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(pts)]
        lab = {r["incident_id"]: r["cluster"] for r in cluster.dbscan(spark.createDataFrame(rows, "incident_id long, latitude double, longitude double"),
                                                                      eps, least).collect()}
        assert [lab[i] for i in range(300)] == brute_dbscan([r[1:] for r in rows], eps, least)


def test_radius_sums_follow_the_border(spark, monkeypatch):
    """60,000 places around three points: sums equal brute force, tested places are few."""
    from tessera.operators import geo
    rng = np.random.default_rng(4)
    places = rng.uniform([40.0, 5.0], [44.0, 10.0], (60_000, 2))
    points = [("a", 42.0, 7.5), ("b", 40.1, 5.1), ("c", -10.0, 100.0)]
    rows = [(float(a), float(b), f"t{i % 3}" if i % 4 else None, 1, float(i % 5)) for i, (a, b) in enumerate(places)]
    df = spark.createDataFrame(rows, "r_latitude double, r_longitude double, r_attack string, n long, casualties double")
    q = spark.createDataFrame(points, "name string, latitude double, longitude double")
    opened = []
    real = geo.materialize

    def count(d, name):
        out = real(d, name)
        if name == "radius-boxes":
            opened.append(out.filter(f"NOT _inside AND n <= {geo.OPENED}").agg({"n": "sum"}).first()[0] or 0)
        return out

    monkeypatch.setattr(geo, "materialize", count)
    for km in (120.0, 150.0):
        opened.clear()
        got = {(r["name"], r["r_attack"]): (r["n"], r["casualties"]) for r in geo.radius_sums(q, df, km, "name", ["r_attack"], ["n", "casualties"]).collect()}
        want = {}
        for name, lat, lon in points:
            for i in np.flatnonzero(brute_km(lat, lon, places) <= km):
                k = (name, rows[i][2])
                n, c = want.get(k, (0, 0.0))
                want[k] = (n + 1, c + rows[i][4])
        assert got == want and sum(n for n, _ in want.values()) > 10_000
        assert 0 < sum(opened) < sum(n for n, _ in want.values()) / 3


def test_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    """A path whose ids lie scattered along it, another one, and a lone node."""
    names, write = [], cluster.materialize
    monkeypatch.setattr(cluster, "materialize", lambda df, name: names.append(name) or write(df, name))
    at = lambda i: (i * 389) % 601
    edges = [tuple(sorted((at(i), at(i + 1)))) for i in range(600) if i != 450]
    nodes = spark.createDataFrame([(i,) for i in [*range(601), 900]], "node long")
    got = {r.node: r.label for r in cluster.connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    first, second = {at(i) for i in range(451)}, {at(i) for i in range(451, 601)}
    assert got == {n: min(first) for n in first} | {n: min(second) for n in second} | {900: 900}
    assert names.count("cc-labels") <= 14


def test_window_points_are_read_once(spark, tmp_path):
    rows = [(i, 2000 + i % 7, 10.0 + i % 5 / 10, 20.0) for i in range(60)] + [(60, None, 10.0, 20.0), (61, 2001, None, 20.0)]
    spark.createDataFrame(rows, "incident_id long, iyear int, latitude double, longitude double").write.parquet(str(tmp_path / "rows"))
    inc = spark.read.parquet(str(tmp_path / "rows"))
    cents = cluster.window_centroids(inc, 5, 150.0, 10)
    assert not any("/rows/" in f for f in cents.inputFiles())      # the incidents are not computed again
    assert [(r.window_start, r.window_end, r.incidents) for r in cents.orderBy("window_start").collect()] == [(2000, 2004, 44), (2005, 2006, 16)]
    assert not any("window-points" in f for f in cluster.migration_vectors(cents).inputFiles())


def test_window_points_are_written_as_they_come(spark, monkeypatch):
    """No filter on computed coordinates stands before the write, where it would be moved into the joins; the rows without a place still go."""
    plans, real = {}, cluster.materialize
    monkeypatch.setattr(cluster, "materialize", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and real(df, name))
    ids = spark.createDataFrame([(i, i % 3) for i in range(90)] + [(90, None)], "incident_id long, k long")
    of = spark.createDataFrame([(k, 2000 + k, 10.0 * k) for k in range(3)], "k long, iyear int, at double")
    place = lambda c: F.when(F.col("incident_id") % 9 == 0, None).otherwise(F.col("at") + F.lit(c))
    inc = ids.join(of, "k").select("incident_id", "iyear", place(1.0).alias("latitude"), place(2.0).alias("longitude"))
    got = {r.cluster: r.incidents for r in cluster.window_centroids(inc, 5, 150.0, 10).collect()}
    assert got == {0: 30, 1: 30, 2: 20} and "% 9" not in plans["window-points"].split("Join", 1)[1]
