"""Density clustering (DBSCAN) as Spark joins, and the hotspot operators around it.

Semantics (haversine DBSCAN, a point counts itself): core if the weight of its
eps-neighbourhood >= min_samples; clusters are connected components of core
points; a border point joins the lowest-numbered adjacent cluster; clusters are
numbered by the smallest ``incident_id`` among their core points; noise is -1.

Plan (see geo.py for the cell grid):
1. Collapse incidents to distinct (keys, lat, lon) with weight and min id — the
   main size cut for geocoded data; all later work is on distinct points.
2. Fine cells (side chord/sqrt 3): a cell whose weight reaches min_samples is all
   core with no pair work at all — the hot-spot-of-a-third-of-the-rows case.
3. Neighbour counts only for points of light cells: a cell range join + exact test where cells hold few points,
   counts of halved boxes (``box_counts``) where they hold many.
4. Core cells are graph nodes (all core points of a cell are mutual neighbours);
   an edge joins two cells holding a core pair within eps, found by halving boxes and not
   by pairing points (``cell_edges``).  Components by
   min-label propagation with hooking and pointer jumping; each round is written as a table
   in the shared checkpoint folder; the driver only sees the count of changed labels.
5. Number clusters, attach border points, join back to every incident.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import chord_for_km, haversine_km, round_even, unit_xyz
from tessera.operators import geo
from tessera.session import checkpoint_dir, materialize


def dbscan(df: DataFrame, eps_km: float, min_samples: int, *, keys: Sequence[str] = (),
           id_col: str = "incident_id", lat: str = "latitude", lon: str = "longitude",
           out: str = "cluster") -> DataFrame:
    """Label every row with coordinates: (id_col, *keys, out).  Rows without
    coordinates leave (as in the reference, which drops them first)."""
    keys = list(keys)
    spark = df.sparkSession
    checkpoint_dir(spark)
    rows = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        id_col, *keys, F.col(lat).alias("latitude"), F.col(lon).alias("longitude"))

    # 1. distinct points
    pts = (rows.groupBy(*keys, "latitude", "longitude")
           .agg(F.count(F.lit(1)).alias("w"), F.min(id_col).alias("pid")))
    pts = materialize(geo.with_cells(pts, eps_km, True), "dbscan-distinct")

    # 2. cell weights; heavy cells are all core
    cells = pts.groupBy(*keys, "_cx", "_cy", "_cz").agg(F.sum("w").alias("cell_w"), F.count(F.lit(1)).alias("cell_n"))
    heavy = cells.filter(F.col("cell_w") >= min_samples).select(*keys, "_cx", "_cy", "_cz")

    adj = geo.cell_adjacency(cells, cells, geo.reach(True), keys)
    other = pts.select(*keys, F.col("_cx").alias("_nx"), F.col("_cy").alias("_ny"),
                       F.col("_cz").alias("_nz"), F.col("pid").alias("qid"),
                       F.col("latitude").alias("q_lat"), F.col("longitude").alias("q_lon"),
                       F.col("w").alias("qw"))

    # 3. neighbour counts of points in light cells: pairs with cells of few points, boxes of the others
    light_pts = pts.join(heavy, [*keys, "_cx", "_cy", "_cz"], "left_anti")
    near = light_pts.select(*keys, "_cx", "_cy", "_cz", "pid", "latitude", "longitude").join(adj, [*keys, "_cx", "_cy", "_cz"])
    large = [F.col(c).alias(n) for c, n in zip(("_cx", "_cy", "_cz"), ("_nx", "_ny", "_nz"), strict=True)]
    large = cells.filter(F.col("cell_n") > FEW).select(*keys, *large)
    pairs = (near.join(large, [*keys, "_nx", "_ny", "_nz"], "left_anti")
             .join(other, [*keys, "_nx", "_ny", "_nz"])
             .filter(haversine_km("latitude", "longitude", "q_lat", "q_lon") <= eps_km)
             .select(*keys, "pid", "qid", "qw"))
    pairs = materialize(pairs, "dbscan-light-pairs")
    counts = pairs.groupBy(*keys, "pid").agg(F.sum("qw").alias("n"))
    beside = near.drop("_cx", "_cy", "_cz").join(large, [*keys, "_nx", "_ny", "_nz"], "left_semi")
    if not large.isEmpty() and not beside.isEmpty():
        counts, pairs = box_counts(beside, other.join(large, [*keys, "_nx", "_ny", "_nz"], "left_semi"), counts, pairs, eps_km, min_samples, keys)
    light_core = counts.filter(F.col("n") >= min_samples).select(*keys, "pid")
    heavy_core = pts.join(heavy, [*keys, "_cx", "_cy", "_cz"], "left_semi").select(*keys, "pid")
    core_ids = light_core.unionByName(heavy_core)
    core = pts.join(core_ids, [*keys, "pid"], "left_semi").select(
        *keys, "pid", "_cx", "_cy", "_cz", "latitude", "longitude")

    # 4. core cells as nodes (node id = smallest core pid of the cell), edges
    nodes = core.groupBy(*keys, "_cx", "_cy", "_cz").agg(F.min("pid").alias("node"))
    core_n = materialize(core.join(nodes, [*keys, "_cx", "_cy", "_cz"]), "dbscan-core")
    nodes = core_n.select(*keys, "_cx", "_cy", "_cz", "node").distinct()
    edges = cell_edges(core_n, nodes, adj, eps_km, keys)
    labels = connected_components(nodes.select("node"), edges)

    # 5. numbering, border points, back to rows
    node_label = nodes.join(labels, "node").select(*keys, "_cx", "_cy", "_cz", "label")
    numbers = (node_label.select(*keys, "label").distinct()
               .withColumn(out, (F.dense_rank().over(
                   Window.partitionBy(*keys).orderBy("label")) - 1).cast("int")))
    core_cluster = (core_n.join(node_label, [*keys, "_cx", "_cy", "_cz"])
                    .join(numbers, [*keys, "label"]).select(*keys, "pid", out))
    border = (pairs.join(core_cluster.withColumnRenamed("pid", "qid"), [*keys, "qid"])
              .join(core_ids, [*keys, "pid"], "left_anti")
              .groupBy(*keys, "pid").agg(F.min(out).alias(out)))
    point_cluster = core_cluster.unionByName(border)
    labelled_pts = (pts.select(*keys, "latitude", "longitude", "pid")
                    .join(point_cluster, [*keys, "pid"], "left")
                    .withColumn(out, F.coalesce(F.col(out), F.lit(-1)).cast("int")).drop("pid"))
    labelled_pts = materialize(labelled_pts, "dbscan-points")
    return rows.join(labelled_pts, [*keys, "latitude", "longitude"]).select(id_col, *keys, out)


POINT_TESTS = 64   # point pairs of two boxes that are tested one by one
FEW = 64           # points of a cell, and
OPENED = 16        # of a smaller box, that are tested one by one against a light point
DEEPEST = 30       # halvings after which points are alike in doubles


def box_counts(beside: DataFrame, points: DataFrame, counts: DataFrame, pairs: DataFrame, eps_km: float, min_samples: int,
               keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Neighbour counts of light points beside cells of many points: (counts, pairs).

    ``beside`` is a row for each light point and such a cell, ``points`` the cells' points.  A cell is a box
    around its points, halved along each axis from level to level.  A box surely within ``eps_km`` counts whole,
    a box surely beyond goes, and only boxes on the border are opened: point by point where they hold few, else by their halves.
    Points that have reached ``min_samples`` stop there, so the work follows the border and not the cells'
    points.  ``counts`` has every light point's total (at least ``min_samples`` for those that stopped); ``pairs`` gets all
    neighbours of the points below ``min_samples``, whose boxes hold fewer points than that.
    """
    side, chord = geo.cell_side(eps_km, True), chord_for_km(eps_km)
    x, y, z = unit_xyz("q_lat", "q_lon")
    pts = materialize(points.withColumns({"x": x, "y": y, "z": z}), "dbscan-large-cells")
    cell, sub = [*keys, "_nx", "_ny", "_nz"], ["sx", "sy", "sz"]

    def at(level: int) -> DataFrame:
        return pts.withColumns({"s" + c: F.floor(F.col(c) / (side / 2 ** level)) for c in "xyz"})

    def boxes(level: int) -> DataFrame:
        ends = [f(c).alias(n + c) for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]
        return at(level).groupBy(*cell, *sub).agg(F.count(F.lit(1)).alias("n"), F.sum("qw").alias("bw"), *ends)

    px, py, pz = unit_xyz("latitude", "longitude")
    todo = beside.withColumns({"px": px, "py": py, "pz": pz}).join(boxes(0), cell)
    far2 = sum(F.pow(F.greatest(F.abs(F.col("p" + c) - F.col("lo" + c)), F.abs(F.col("p" + c) - F.col("hi" + c))), F.lit(2)) for c in "xyz")
    near2 = sum(F.pow(F.greatest(F.lit(0.0), F.col("lo" + c) - F.col("p" + c), F.col("p" + c) - F.col("hi" + c)), F.lit(2)) for c in "xyz")
    whole, level = [], 0
    while True:
        judged = materialize(todo.filter(near2 <= chord ** 2 * (1 + 1e-9)).withColumn("_inside", far2 <= chord ** 2 * (1 - 1e-9)), "dbscan-point-boxes")
        inside = judged.filter("_inside").select(*keys, "pid", *cell[len(keys):], *sub, "bw")
        whole.append((level, inside))
        few = (F.col("n") <= OPENED) | F.lit(level >= DEEPEST)
        tested = (judged.filter(~F.col("_inside") & few).select(*cell, *sub, "pid", "latitude", "longitude")
                  .join(at(level).select(*cell, *sub, "qid", "qw", "q_lat", "q_lon"), [*cell, *sub])
                  .filter(haversine_km("latitude", "longitude", "q_lat", "q_lon") <= eps_km).select(*keys, "pid", "qid", "qw"))
        tested = materialize(tested, "dbscan-border-pairs")
        pairs = pairs.unionByName(tested)
        more = inside.select(*keys, "pid", F.col("bw").alias("n")).unionByName(tested.select(*keys, "pid", F.col("qw").alias("n")))
        counts = materialize(counts.unionByName(more).groupBy(*keys, "pid").agg(F.sum("n").alias("n")), "dbscan-light-counts")
        done = counts.filter(F.col("n") >= min_samples).select(*keys, "pid")
        rest = judged.filter(~F.col("_inside") & ~few).join(done, [*keys, "pid"], "left_anti")
        if rest.isEmpty():
            break
        level += 1
        halves = boxes(level).withColumns({f"u{c}": F.floor(F.col("s" + c) / 2) for c in "xyz"})
        up = rest.select(*cell, "pid", "latitude", "longitude", "px", "py", "pz", *[F.col("s" + c).alias("u" + c) for c in "xyz"])
        todo = up.join(halves, [*cell, "ux", "uy", "uz"]).drop("ux", "uy", "uz")
    for lev, inside in whole:                       # neighbours of points that stay below: fewer than min_samples each
        below = inside.join(done, [*keys, "pid"], "left_anti")
        pairs = pairs.unionByName(below.drop("bw").join(at(lev).select(*cell, *sub, "qid", "qw"), [*cell, *sub]).select(*keys, "pid", "qid", "qw"))
    return counts, pairs


def cell_edges(core: DataFrame, nodes: DataFrame, adj: DataFrame, eps_km: float, keys: Sequence[str]) -> DataFrame:
    """Distinct (a, b), a < b, of adjacent core cells with two core points within ``eps_km``.

    Never all pairs of two cells' points: a cell is a box around its points, and of two boxes the
    largest and the smallest possible distance are known.  Surely near boxes settle their cells,
    surely far ones go, boxes of few points are tested point by point, and the rest are halved along each
    axis.  As soon as one pair of boxes is near, nothing more of its cells is looked at, so the
    work follows the number of points and not its square.
    """
    side, chord = geo.cell_side(eps_km, True), chord_for_km(eps_km)
    x, y, z = unit_xyz("latitude", "longitude")
    pts = core.select("node", "pid", "latitude", "longitude", x.alias("x"), y.alias("y"), z.alias("z"))

    def at(level: int) -> DataFrame:
        width = side / 2 ** level
        return pts.withColumns({"s" + c: F.floor(F.col(c) / width) for c in "xyz"})

    def boxes(level: int) -> DataFrame:
        ends = [f(c).alias(n + c) for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]
        return at(level).groupBy("node", "sx", "sy", "sz").agg(F.count(F.lit(1)).alias("n"), *ends)

    def side_of(box: DataFrame, p: str) -> DataFrame:
        return box.select(*[F.col(c).alias(p + c) for c in box.columns])

    near_cells = (adj.join(nodes, [*keys, "_cx", "_cy", "_cz"])
                  .join(nodes.select(*keys, F.col("_cx").alias("_nx"), F.col("_cy").alias("_ny"), F.col("_cz").alias("_nz"),
                                     F.col("node").alias("other")), [*keys, "_nx", "_ny", "_nz"])
                  .filter("node < other").select(F.col("node").alias("a_node"), F.col("other").alias("b_node")))
    box = materialize(boxes(0), "dbscan-boxes")
    pairs = near_cells.join(side_of(box, "a_"), "a_node").join(side_of(box, "b_"), "b_node")
    far2 = sum(F.pow(F.greatest(F.col("a_hi" + c) - F.col("b_lo" + c), F.col("b_hi" + c) - F.col("a_lo" + c)), F.lit(2)) for c in "xyz")
    near2 = sum(F.pow(F.greatest(F.lit(0.0), F.col("a_lo" + c) - F.col("b_hi" + c), F.col("b_lo" + c) - F.col("a_hi" + c)), F.lit(2)) for c in "xyz")
    found, level = None, 0
    while True:
        judged = materialize(pairs.filter(near2 <= chord ** 2 * (1 + 1e-9)).withColumn("_near", far2 <= chord ** 2 * (1 - 1e-9)), "dbscan-box-pairs")
        settled = judged.filter("_near").select("a_node", "b_node").distinct()
        rest = judged.join(settled, ["a_node", "b_node"], "left_anti")
        few = F.col("a_n") * F.col("b_n") <= POINT_TESTS
        here = at(level)
        side_a = here.select(*[F.col(c).alias("a_" + c) for c in ("node", "sx", "sy", "sz", "latitude", "longitude")])
        side_b = here.select(*[F.col(c).alias("b_" + c) for c in ("node", "sx", "sy", "sz", "latitude", "longitude")])
        tested = (rest.filter(few).select("a_node", "a_sx", "a_sy", "a_sz", "b_node", "b_sx", "b_sy", "b_sz")
                  .join(side_a, ["a_node", "a_sx", "a_sy", "a_sz"]).join(side_b, ["b_node", "b_sx", "b_sy", "b_sz"])
                  .filter(haversine_km("a_latitude", "a_longitude", "b_latitude", "b_longitude") <= eps_km)
                  .select("a_node", "b_node").distinct())
        now = materialize(settled.union(tested).distinct(), "dbscan-cell-edges")
        found = now if found is None else found.union(now)
        rest = rest.filter(~few).join(now, ["a_node", "b_node"], "left_anti")
        if rest.isEmpty():
            return found.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
        level += 1
        halves = boxes(level)
        kids = lambda p: side_of(halves, p).withColumns({f"{p}u{c}": F.floor(F.col(f"{p}s{c}") / 2) for c in "xyz"})
        up = rest.select("a_node", "b_node", *[F.col(f"{p}s{c}").alias(f"{p}u{c}") for p in ("a_", "b_") for c in "xyz"])
        pairs = (up.join(kids("a_"), ["a_node", "a_ux", "a_uy", "a_uz"]).join(kids("b_"), ["b_node", "b_ux", "b_uy", "b_uz"])
                 .drop("a_ux", "a_uy", "a_uz", "b_ux", "b_uy", "b_uz"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Min-label propagation with hooking and pointer jumping: returns (node, label=min node of component).

    Each round: label(a) = min(label(a), labels of neighbours), and the node that label(a) names gets the
    same minimum, so all that follow that node move with it; then label = label(label).  Rounds
    follow the logarithm of a component's length and not the length.
    Labels only decrease and always name a node of the same component, so the fixed
    point is the component minimum.  Every round is written to the shared folder.
    """
    und = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                      "cc-edges")
    labels = nodes.select("node", F.col("node").alias("label")).distinct()
    while True:
        nb = (und.join(labels.withColumnRenamed("node", "b").withColumnRenamed("label", "lb"), "b")
              .groupBy("a").agg(F.min("lb").alias("nmin")))
        near = labels.join(nb.withColumnRenamed("a", "node"), "node", "left")
        hook = near.groupBy(F.col("label").alias("node")).agg(F.min("nmin").alias("hmin"))
        step = (near.join(hook, "node", "left")
                .select("node", "label", F.least("label", F.coalesce("nmin", "label"), F.coalesce("hmin", "label")).alias("l1")))
        jump = labels.select(F.col("node").alias("l1"), F.col("label").alias("l2"))
        new = (step.join(jump, "l1", "left")
               .select("node", F.col("label").alias("old"),
                       F.least("l1", F.coalesce("l2", "l1")).alias("label")))
        new = materialize(new, "cc-labels")
        changed = new.filter(F.col("label") != F.col("old")).count()
        labels = new.select("node", "label")
        if changed == 0:
            return labels


def hotspot_summary(clustered: DataFrame) -> DataFrame:
    """Size, total/mean severity, centroid, modal country, rank by total severity.

    ``clustered`` carries cluster, tsi, latitude, longitude, country_txt.  The rank
    window runs over the per-cluster aggregate, not over rows.
    """
    agg = (clustered.filter(F.col("cluster") != -1).groupBy("cluster")
           .agg(F.count(F.lit(1)).alias("incidents"), F.sum("tsi").alias("total_tsi"),
                F.avg("tsi").alias("avg_tsi"), F.avg("latitude").alias("centroid_lat"),
                F.avg("longitude").alias("centroid_lon"),
                F.mode("country_txt", True).alias("countries")))
    return agg.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("total_tsi"), F.col("cluster"))))


def round_summary(summary: DataFrame) -> DataFrame:
    return summary.withColumns({c: round_even(c, 6) for c in
                                ["total_tsi", "avg_tsi", "centroid_lat", "centroid_lon"]})


def window_centroids(df: DataFrame, window_years: int = 5, eps_km: float = 150.0,
                     min_samples: int = 10) -> DataFrame:
    """DBSCAN per 5-year window anchored at the first year, all windows in one run.

    The points are written once, with the columns that are used, and read from there.
    The window is an extra key of every join, so all windows cluster together.
    Windows with fewer rows than ``min_samples`` cannot hold a core point and
    so yield no centroid, as in the reference.
    """
    pts = materialize(df.select("incident_id", "iyear", "latitude", "longitude"), "window-points")
    # filtered as they are read: a filter before the write is moved into the joins behind ``df``, which compute its expressions again
    pts = pts.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("iyear").isNotNull())
    y0 = pts.select(F.min("iyear")).scalar()
    y1 = pts.select(F.max("iyear")).scalar()
    start = y0 + F.floor((F.col("iyear") - y0) / window_years).cast("int") * window_years
    pts = pts.withColumn("window_start", start.cast("int"))
    labelled = dbscan(pts, eps_km, min_samples, keys=["window_start"])
    members = (pts.join(labelled, ["incident_id", "window_start"]).filter(F.col("cluster") >= 0))
    return (members.groupBy("window_start", "cluster")
            .agg(F.avg("latitude").alias("centroid_lat"), F.avg("longitude").alias("centroid_lon"),
                 F.count(F.lit(1)).alias("incidents"))
            .withColumn("window_end", F.least(F.col("window_start") + (window_years - 1), y1).cast("int")))


def migration_vectors(centroids: DataFrame, max_link_km: float = 500.0) -> DataFrame:
    """Link each centroid to the nearest one (< max_link_km) in the next present window.

    Consecutive windows come from a dense rank over the distinct window starts (a
    tiny table); the candidate pairs come from the cell range join, not all pairs.
    The centroids are written once: windows, both sides and their cells are read from there.
    """
    centroids = materialize(centroids, "window-centroids")
    wins = (centroids.select("window_start").distinct()
            .withColumn("w_idx", F.dense_rank().over(Window.orderBy("window_start"))))
    c = centroids.join(wins, "window_start")
    left = c.select(F.col("w_idx"), "window_start", "window_end", "cluster",
                    F.col("centroid_lat").alias("latitude"), F.col("centroid_lon").alias("longitude"),
                    "incidents")
    right = c.select((F.col("w_idx") - 1).alias("w_idx"),
                     F.col("window_start").alias("r_window_start"),
                     F.col("window_end").alias("r_window_end"), F.col("cluster").alias("r_cluster"),
                     F.col("centroid_lat").alias("r_latitude"), F.col("centroid_lon").alias("r_longitude"),
                     F.col("incidents").alias("r_incidents"))
    pairs = geo.pairs_within(left, right, max_link_km, keys=["w_idx"], strict=True)
    best = pairs.groupBy("w_idx", "cluster").agg(
        F.min_by(F.struct(*[F.col(x) for x in pairs.columns]), F.struct("dist_km", "r_cluster"))
        .alias("b")).select("b.*")
    return best.select(
        F.col("latitude").alias("from_lat"), F.col("longitude").alias("from_lon"),
        F.col("r_latitude").alias("to_lat"), F.col("r_longitude").alias("to_lon"),
        round_even("dist_km", 1).alias("drift_km"),
        F.col("incidents").alias("from_incidents"), F.col("r_incidents").alias("to_incidents"),
        F.concat_ws("-", "window_start", "window_end").alias("window_from"),
        F.concat_ws("-", "r_window_start", "r_window_end").alias("window_to"),
        F.col("window_start").alias("window_start_from"), F.col("cluster").alias("cluster_from"),
        F.col("r_cluster").alias("cluster_to"))


def extrapolate(migrations: DataFrame, latest_only: bool = False) -> DataFrame:
    """Next position = to + (to - from), clamped to lat +-85, lon +-180."""
    m = migrations
    if latest_only:
        last = m.select(F.max("window_start_from")).scalar()
        m = m.filter(F.col("window_start_from") == last)
    plat = F.col("to_lat") + (F.col("to_lat") - F.col("from_lat"))
    plon = F.col("to_lon") + (F.col("to_lon") - F.col("from_lon"))
    return m.select(
        F.col("to_lat").alias("from_lat"), F.col("to_lon").alias("from_lon"),
        F.greatest(F.lit(-85.0), F.least(F.lit(85.0), plat)).alias("to_lat"),
        F.greatest(F.lit(-180.0), F.least(F.lit(180.0), plon)).alias("to_lon"),
        "drift_km", F.col("window_to").alias("window_from"),
        F.lit("Predicted").alias("window_to"), F.lit("extrapolation").alias("source"),
        "window_start_from", "cluster_from")
