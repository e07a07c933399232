"""Spatial operators: haversine, cell range joins, grids, centroids, radius summaries.

Range joins ("every pair closer than r km") are equi-joins on cells of a 3-D grid
over the unit sphere: each point maps to cell ``floor(xyz / side)``; a pair within
the chord of r km differs by at most ``reach`` cells per axis.  Only occupied
cells are joined (cells x neighbour offsets -> occupied cells), then the exact
haversine test filters the candidates.  No pole or antimeridian special cases.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import chord_for_km, haversine_km, round_even, unit_xyz
from tessera.functions.position import grouped_median
from tessera.session import materialize


def with_cells(df: DataFrame, km: float, fine: bool, lat: str = "latitude",
               lon: str = "longitude") -> DataFrame:
    """Attach cell coordinates ``_cx, _cy, _cz``.

    ``fine=True``: side = chord/sqrt(3) (slightly shrunk), so two points in one cell
    are always within ``km`` (DBSCAN uses that); neighbours are within 2 cells.
    ``fine=False``: side = chord; neighbours within 1 cell (27 offsets).
    """
    side = cell_side(km, fine)
    x, y, z = unit_xyz(lat, lon)
    return df.withColumns({"_cx": F.floor(x / side), "_cy": F.floor(y / side),
                           "_cz": F.floor(z / side)})


def cell_side(km: float, fine: bool) -> float:
    c = chord_for_km(km)
    return c / math.sqrt(3.0) * (1.0 - 1e-9) if fine else c


def reach(fine: bool) -> int:
    return 2 if fine else 1


def neighbour_cells(cells: DataFrame, r: int) -> DataFrame:
    """Every cell in ``cells`` with the coordinates of its (2r+1)^3 neighbourhood.

    ``explode`` of a fixed offset sequence, so no join is needed to fan out.
    """
    seq = F.sequence(F.lit(-r), F.lit(r))
    return (cells.withColumn("_dx", F.explode(seq)).withColumn("_dy", F.explode(seq))
            .withColumn("_dz", F.explode(seq))
            .withColumns({"_nx": F.col("_cx") + F.col("_dx"), "_ny": F.col("_cy") + F.col("_dy"),
                          "_nz": F.col("_cz") + F.col("_dz")})
            .drop("_dx", "_dy", "_dz"))


def cell_adjacency(left_cells: DataFrame, right_cells: DataFrame, r: int,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of occupied cells (left cell -> right cell) within ``r`` cells per axis.

    Output columns: keys, _cx,_cy,_cz (left cell), _nx,_ny,_nz (right cell).
    """
    lc = left_cells.select(*keys, "_cx", "_cy", "_cz").distinct()
    rc = (right_cells.select(*keys, F.col("_cx").alias("_nx"), F.col("_cy").alias("_ny"),
                             F.col("_cz").alias("_nz")).distinct())
    return neighbour_cells(lc, r).join(rc, [*keys, "_nx", "_ny", "_nz"], "inner")


def pairs_within(left: DataFrame, right: DataFrame, km: float, *, keys: Sequence[str] = (),
                 left_lat: str = "latitude", left_lon: str = "longitude",
                 right_lat: str = "r_latitude", right_lon: str = "r_longitude",
                 strict: bool = False, dist_col: str = "dist_km") -> DataFrame:
    """Range join: all (left, right) rows whose haversine distance is <= km (< km if strict).

    Right columns must not collide with left ones (prefix them first); ``keys``
    are extra equi-join columns present on both sides.
    """
    lcells = with_cells(left, km, False, left_lat, left_lon)
    rcells = with_cells(right, km, False, right_lat, right_lon)
    adj = cell_adjacency(lcells, rcells, 1, keys)
    rr = rcells.withColumnsRenamed({"_cx": "_nx", "_cy": "_ny", "_cz": "_nz"})
    cand = lcells.join(adj, [*keys, "_cx", "_cy", "_cz"]).join(rr, [*keys, "_nx", "_ny", "_nz"])
    d = haversine_km(left_lat, left_lon, right_lat, right_lon)
    cand = cand.withColumn(dist_col, d)
    cond = F.col(dist_col) < km if strict else F.col(dist_col) <= km
    return cand.filter(cond).drop("_cx", "_cy", "_cz", "_nx", "_ny", "_nz")


# ---- G7 / G8 / G9 / G12 ---------------------------------------------------------------

def country_centroids(df: DataFrame) -> DataFrame:
    """Median latitude / longitude per country (rows with coordinates only)."""
    located = df.filter(F.col("country_txt").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return (grouped_median(located, "country_txt", ["latitude", "longitude"])
            .withColumnsRenamed({"latitude": "centroid_lat", "longitude": "centroid_lon"}))


def grid_density(df: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Incidents and severity per lat/lon grid cell of ``cell_deg`` degrees."""
    pts = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return (pts.groupBy(F.floor(F.col("latitude") / cell_deg).alias("cell_lat"),
                        F.floor(F.col("longitude") / cell_deg).alias("cell_lon"))
            .agg(F.count(F.lit(1)).alias("incidents"), round_even(F.sum("tsi"), 6).alias("total_tsi"))
            .withColumns({"center_lat": (F.col("cell_lat") + 0.5) * cell_deg,
                          "center_lon": (F.col("cell_lon") + 0.5) * cell_deg}))


def hex_cells(df: DataFrame, size: float = 1.0, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Attach axial coordinates ``hex_q, hex_r`` of hexagons with a corner at the top and sides of ``size`` degrees.

    The point's fractional cube coordinates (q, r, -q-r) are rounded, and the one that moved
    farthest is set from the other two.
    """
    x, y = F.col(lon) / size, F.col(lat) / size
    cube = df.withColumns({"_q": x * (math.sqrt(3.0) / 3) - y / 3, "_r": y * (2.0 / 3)}).withColumn("_s", -F.col("_q") - F.col("_r"))
    near = {c: F.floor(F.col(f"_{c}") + 0.5) for c in "qrs"}
    cube = cube.withColumns({f"_n{c}": e for c, e in near.items()}).withColumns({f"_d{c}": F.abs(F.col(f"_n{c}") - F.col(f"_{c}")) for c in "qrs"})
    far_q = (F.col("_dq") > F.col("_dr")) & (F.col("_dq") > F.col("_ds"))
    far_r = ~far_q & (F.col("_dr") > F.col("_ds"))
    return cube.withColumns({"hex_q": F.when(far_q, -F.col("_nr") - F.col("_ns")).otherwise(F.col("_nq")),
                             "hex_r": F.when(far_r, -F.col("_nq") - F.col("_ns")).otherwise(F.col("_nr"))}).drop(*[f"_{k}{c}" for k in ("", "n", "d") for c in "qrs"])


def hex_density(df: DataFrame, size: float = 1.0) -> DataFrame:
    """Incidents and severity per hexagon, with the hexagon's centre."""
    pts = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return (hex_cells(pts, size).groupBy("hex_q", "hex_r")
            .agg(F.count(F.lit(1)).alias("incidents"), round_even(F.sum("tsi"), 6).alias("total_tsi"))
            .withColumns({"center_lat": round_even(F.col("hex_r") * (1.5 * size), 6),
                          "center_lon": round_even((F.col("hex_q") + F.col("hex_r") / 2) * (math.sqrt(3.0) * size), 6)}))


def peak_cell(df: DataFrame) -> DataFrame:
    """Per country, incidents in its busiest 0.1-degree cell (numpy rounding)."""
    pts = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    cells = (pts.groupBy("country_txt", F.rint(F.col("latitude") * 10).alias("lat_bin"),
                         F.rint(F.col("longitude") * 10).alias("lon_bin"))
             .agg(F.count(F.lit(1)).alias("n")))
    return cells.groupBy("country_txt").agg(F.max("n").alias("peak_cell_incidents"))


def severity_layer(df: DataFrame, year: int | None = None) -> DataFrame:
    """Severity-weighted country layer for year ``year``, or per (year, country)."""
    keys = ["country_txt"] if year is not None else ["iyear", "country_txt"]
    src = df.filter(F.col("iyear") == year) if year is not None else df
    return (src.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("incidents"), round_even(F.sum("tsi"), 6).alias("total_tsi"),
                 round_even(F.avg("latitude"), 6).alias("mean_lat"),
                 round_even(F.avg("longitude"), 6).alias("mean_lon")))


# ---- G10 / G11 / G13 -----------------------------------------------------------------

OPENED = 16      # rows of a border box that are tested one by one
DEEPEST = 30     # halvings after which places are alike in doubles


def radius_sums(points: DataFrame, rows: DataFrame, km: float, key: str, by: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """(key, by, sums): totals of ``rows`` within ``km`` of each point, from a hierarchy of boxes.

    ``points`` is (key, latitude, longitude), ``rows`` (r_latitude, r_longitude, by, sums).  Cells around a point are boxes
    around their rows, halved along each axis from level to level.  A box surely within the radius
    adds its sums, a box surely outside goes, and only boxes on the border are opened, down to ``OPENED`` rows, which
    are tested one by one.  The work of a point follows its circle's border, not its area.
    """
    by, sums, side, chord = list(by), list(sums), cell_side(km, False), chord_for_km(km)
    cell, sub = ["_nx", "_ny", "_nz"], ["sx", "sy", "sz"]
    x, y, z = unit_xyz("r_latitude", "r_longitude")
    pts = rows.withColumns({"x": x, "y": y, "z": z})
    pts = materialize(pts.withColumns({f"_n{c}": F.floor(F.col(c) / side) for c in "xyz"}), "radius-rows")

    def at(level: int) -> DataFrame:
        return pts.withColumns({"s" + c: F.floor(F.col(c) / (side / 2 ** level)) for c in "xyz"})

    def boxes(level: int) -> DataFrame:
        ends = [f(c).alias(n + c) for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]
        return at(level).groupBy(*cell, *sub).agg(F.count(F.lit(1)).alias("n"), *ends)

    px, py, pz = unit_xyz("latitude", "longitude")
    around = neighbour_cells(with_cells(points, km, False), 1).drop("_cx", "_cy", "_cz")
    todo = around.withColumns({"px": px, "py": py, "pz": pz}).join(boxes(0), cell)
    far2 = sum(F.pow(F.greatest(F.abs(F.col("p" + c) - F.col("lo" + c)), F.abs(F.col("p" + c) - F.col("hi" + c))), F.lit(2)) for c in "xyz")
    near2 = sum(F.pow(F.greatest(F.lit(0.0), F.col("lo" + c) - F.col("p" + c), F.col("p" + c) - F.col("hi" + c)), F.lit(2)) for c in "xyz")
    total, level = [], 0
    while True:
        judged = materialize(todo.filter(near2 <= chord ** 2 * (1 + 1e-9)).withColumn("_inside", far2 <= chord ** 2 * (1 - 1e-9)), "radius-boxes")
        few = (F.col("n") <= OPENED) | F.lit(level >= DEEPEST)
        whole = at(level).groupBy(*cell, *sub, *by).agg(*[F.sum(c).alias(c) for c in sums])
        total.append(judged.filter("_inside").select(key, *cell, *sub).join(whole, [*cell, *sub]).select(key, *by, *sums))
        border = judged.filter(~F.col("_inside") & few).select(key, "latitude", "longitude", *cell, *sub)
        total.append(border.join(at(level).select(*cell, *sub, "r_latitude", "r_longitude", *by, *sums), [*cell, *sub])
                     .filter(haversine_km("latitude", "longitude", "r_latitude", "r_longitude") <= km).select(key, *by, *sums))
        rest = judged.filter(~F.col("_inside") & ~few)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, total).groupBy(key, *by).agg(*[F.sum(c).alias(c) for c in sums])
        level += 1
        halves = boxes(level).withColumns({f"u{c}": F.floor(F.col("s" + c) / 2) for c in "xyz"})
        up = rest.select(key, "latitude", "longitude", "px", "py", "pz", *cell, *[F.col("s" + c).alias("u" + c) for c in "xyz"])
        todo = up.join(halves, [*cell, "ux", "uy", "uz"]).drop("ux", "uy", "uz")


def radius_summary(points: DataFrame, incidents: DataFrame, km: float,
                   point_key: str = "name", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """For many query points, incidents within ``km``: count, casualties, dominant type.

    Sums over whole boxes and a test of the places on the border (``radius_sums``); points without incidents stay (count 0).
    """
    q = points.select(point_key, F.col(lat).alias("latitude"), F.col(lon).alias("longitude"))
    # incidents collapse to places and attack types before any pair is made
    inc = (incidents.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
           .groupBy(F.col("latitude").alias("r_latitude"), F.col("longitude").alias("r_longitude"), F.col("attacktype1_txt").alias("r_attack"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("nkill") + F.col("nwound")).alias("casualties")))
    by_type = radius_sums(q, inc, km, point_key, ["r_attack"], ["n", "casualties"])
    top = F.min(F.when(F.col("r_attack").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("r_attack").alias("a"))))
    agg = by_type.groupBy(point_key).agg(
        F.sum("n").alias("incidents"), round_even(F.sum("casualties"), 6).alias("casualties"), top.alias("top"))
    return (points.select(point_key).join(agg, point_key, "left")
            .select(point_key, F.coalesce("incidents", F.lit(0)).alias("incidents"),
                    F.coalesce("casualties", F.lit(0.0)).alias("casualties"), F.col("top.a").alias("dominant_attack")))


def asset_exposure(assets: DataFrame, incidents: DataFrame, hotspots: DataFrame,
                   km: float = 150.0) -> DataFrame:
    """Incidents and hotspots within ``km`` of each asset, and the nearest hotspot."""
    q = assets.select("name", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    inc = (incidents.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
           .groupBy(F.col("latitude").alias("r_latitude"), F.col("longitude").alias("r_longitude"))
           .agg(F.count(F.lit(1)).alias("incidents_within")))                     # places, not incidents
    n_inc = radius_sums(q, inc, km, "name", sums=["incidents_within"])
    hs = hotspots.select(F.col("cluster").alias("r_cluster"), F.col("centroid_lat").alias("r_latitude"),
                         F.col("centroid_lon").alias("r_longitude"))
    hp = pairs_within(q, hs, km)
    near = hp.groupBy("name").agg(
        F.count(F.lit(1)).alias("hotspots_within"),
        F.min_by("r_cluster", F.struct("dist_km", "r_cluster")).alias("nearest_hotspot"),
        round_even(F.min("dist_km"), 6).alias("nearest_km"))
    return (assets.select("name", "type", "country", "status").join(n_inc, "name", "left")
            .join(near, "name", "left")
            .withColumn("incidents_within", F.coalesce("incidents_within", F.lit(0)))
            .withColumn("hotspots_within", F.coalesce("hotspots_within", F.lit(0))))


def hotspot_extent(clustered: DataFrame, summary: DataFrame) -> DataFrame:
    """Bounding box and farthest member from the centroid, per hotspot."""
    members = clustered.filter(F.col("cluster") >= 0)
    cent = summary.select("cluster", "centroid_lat", "centroid_lon")
    j = members.join(cent, "cluster")
    return j.groupBy("cluster").agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        round_even(F.max(haversine_km("latitude", "longitude", "centroid_lat", "centroid_lon")), 6)
        .alias("radius_km"))
