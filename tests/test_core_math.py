"""Scoring, distance, risk clamps and group similarity (restated reference assertions)."""

import math

from pyspark.sql import functions as F

from tessera.functions.expr import haversine_km
from tessera.operators import network, risk, scoring


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_single_severity(spark):
    assert _one(spark, scoring.single_score(0, 0, 0, 0)) == 0.0
    big = _one(spark, scoring.single_score(1000, 1000, 1, 1))
    assert 0 <= big <= 100
    assert _one(spark, scoring.single_score(0, 0, 1, 0)) > 0


def test_severity_rows_success_above_failure(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1), (1.0, 0.0, 0), (-2.0, None, 1)], "nkill double, nwound double, success int")
    out = [r["tsi"] for r in scoring.score_with_bounds(df).collect()]
    assert out[0] > out[1]
    assert all(0 <= v <= 100 for v in out)


def test_labels(spark):
    got = [_one(spark, scoring.severity_label(F.lit(v))) for v in (80.0, 50.0, 25.0, 10.0)]
    assert got == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def test_haversine(spark):
    bk = _one(spark, haversine_km(F.lit(33.3152), F.lit(44.3661), F.lit(34.5553), F.lit(69.2075)))
    lp = _one(spark, haversine_km(F.lit(51.5074), F.lit(-0.1278), F.lit(48.8566), F.lit(2.3522)))
    assert abs(bk - 2273) <= 50
    assert abs(lp - 344) <= 20


def test_risk_components_are_capped(spark):
    rows = [("Hot", 10.0, 20.0, 50.0)] * 1000 + [("Other", 1.0 + (i % 90), 2.0 + (i % 170), 0.0) for i in range(9000)]
    hist = spark.createDataFrame(rows, "country_txt string, latitude double, longitude double, nkill double")
    live = spark.createDataFrame([], "country string, severity string")
    r = risk.country_risk(hist, live).filter("country_txt = 'Hot'").first()
    assert math.isclose(r["c_activity"], 35.0)
    assert math.isclose(r["c_density"], 10.0)
    assert r["c_recent"] == 0 and r["c_instability"] == 0


def test_risk_levels(spark):
    got = [_one(spark, risk.risk_level(F.lit(v))) for v in (10, 30, 55, 75)]
    assert got == ["Low", "Medium", "High", "Critical"]


def test_group_vectors_threshold(spark):
    prof = spark.createDataFrame(
        [("A", "f1", 1.0), ("A", "f2", 0.0), ("A", "f3", 0.0),
         ("B", "f1", 0.9), ("B", "f2", 0.1), ("B", "f3", 0.0),
         ("C", "f1", 0.0), ("C", "f2", 0.0), ("C", "f3", 1.0)],
        "gname string, feature string, weight double")
    edges = {(r["g1"], r["g2"]) for r in network.similarity_edges(prof, 0.85).collect()}
    assert edges == {("A", "B")}


def test_prefix_filter_is_exact(spark, small):
    """Prefix-filtered edges equal the brute-force pairwise cosine at several thresholds."""
    prof = network.group_profiles(spark.table("incidents"), 10)
    rows = prof.collect()
    vec = {}
    for r in rows:
        vec.setdefault(r["gname"], {})[r["feature"]] = r["weight"]
    names = sorted(vec)
    for t in (0.5, 0.9, 0.97):
        want = set()
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                d = sum(w * vec[b].get(f, 0.0) for f, w in vec[a].items())
                na = math.sqrt(sum(w * w for w in vec[a].values()))
                nb = math.sqrt(sum(w * w for w in vec[b].values()))
                if na and nb and d / (na * nb) >= t:
                    want.add((a, b))
        got = {(r["g1"], r["g2"]) for r in network.similarity_edges(prof, t).collect()}
        assert got == want, t


def test_one_feature_of_all_groups(spark, monkeypatch):
    """20,000 groups share a heavy feature: its postings go as pairs of small parts, far angles never meet."""
    rows = []
    for i in range(20_000):
        far = i % 2                                    # half the groups hold little of it: their angle is far off
        rows += [(f"g{i:05d}", "all", 0.3 if far else 0.85), (f"g{i:05d}", f"own{i % 2}{i // 2 % 2500:04d}", 1.0 if far else 0.5268)]
    prof = spark.createDataFrame(rows, "gname string, feature string, weight double").repartition(8)
    held = {}
    real = network.materialize
    monkeypatch.setattr(network, "materialize", lambda df, name: held.setdefault(name, real(df, name)))
    edges = network.similarity_edges(prof, 0.8)
    got = edges.collect()
    want = {(f"g{a:05d}", f"g{b:05d}") for a in range(20_000) for b in range(a + 5000, 20_000, 5000)}
    assert {(r["g1"], r["g2"]) for r in got} == want and len(got) == len(want)
    parts = held["network-parts"].selectExpr("frank", "angle", "size(groups) AS n").collect()
    assert max(r["n"] for r in parts) < 2 * network.PART
    assert len({r["angle"] for r in parts if r["n"] > 5}) >= 1


def test_angles_of_postings_are_cut(spark):
    """Groups on one feature at all angles, parts of a few groups, against brute force."""
    import numpy as np
    rng = np.random.default_rng(3)
    vec = {f"g{i:03d}": {"all": float(rng.random()) + 0.01, f"f{i % 7}": float(rng.random()), f"h{i % 11}": float(rng.random())} for i in range(150)}
    prof = spark.createDataFrame([(g, f, w) for g, v in vec.items() for f, w in v.items()], "gname string, feature string, weight double")
    norm = {g: math.sqrt(sum(w * w for w in v.values())) for g, v in vec.items()}
    for t, part in ((0.2, 256), (0.9, 3), (0.99, 256), (1.0, 4)):
        want = {(a, b) for a in vec for b in vec if a < b and sum(w * vec[b].get(f, 0) for f, w in vec[a].items()) / norm[a] / norm[b] >= t}
        network.PART, before = part, network.PART
        try:
            assert {(r["g1"], r["g2"]) for r in network.similarity_edges(prof, t).collect()} == want
        finally:
            network.PART = before


def test_points_lie_in_the_nearest_hexagon(spark):
    import numpy as np
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), 1.0) for a, b in rng.uniform([-80, -179], [80, 179], (400, 2))]
    from tessera.operators import geo
    got = geo.hex_cells(spark.createDataFrame(rows, "latitude double, longitude double, tsi double"), 2.5).collect()
    centre = lambda q, r: (1.5 * 2.5 * r, math.sqrt(3) * 2.5 * (q + r / 2))
    for x in got:
        d = {(i, j): math.dist(centre(x.hex_q + i, x.hex_r + j), (x.latitude, x.longitude)) for i in (-1, 0, 1) for j in (-1, 0, 1)}
        assert min(d, key=d.get) == (0, 0) and d[0, 0] <= 2.5 + 1e-9
    assert geo.hex_density(spark.createDataFrame(rows, "latitude double, longitude double, tsi double"), 2.5).agg({"incidents": "sum"}).first()[0] == 400
