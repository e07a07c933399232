"""Perpetrator-group profiles and the similarity network.

Profiles are long (gname, feature, weight), never a wide pivot.  Cosine edges use
exact prefix filtering (all-pairs similarity search): with unit vectors and a global
feature order (rarest first), each group indexes only the prefix of its features
whose remaining squared mass is still >= t^2.  Two groups whose prefixes share no
feature have cosine < t (Cauchy-Schwarz on the shorter suffix).  Groups that share a prefix feature meet
as parts of its postings of bounded size, scored exactly on all features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.session import materialize


def eligible_groups(df: DataFrame, min_incidents: int = 50, region: str | None = None) -> DataFrame:
    """N1 (+ N6): known groups with at least ``min_incidents`` rows: (gname, incidents)."""
    rows = df if region is None else df.filter(F.col("region_txt") == region)
    rows = rows.filter(F.col("gname").isNotNull() & (F.col("gname") != "Unknown"))
    return (rows.groupBy("gname").agg(F.count(F.lit(1)).alias("incidents"))
            .filter(F.col("incidents") >= min_incidents))


def group_profiles(df: DataFrame, min_incidents: int = 50, region: str | None = None) -> DataFrame:
    """Share of each category per group; prefix = column name before the first '_'.

    NULL categories count in the denominator only (as dummy columns of all zeros).
    """
    groups = eligible_groups(df, min_incidents, region)
    rows = df if region is None else df.filter(F.col("region_txt") == region)
    rows = rows.join(groups.select("gname"), "gname", "left_semi")
    feats = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(c.split("_")[0] + "_"), F.col(c)))
                      for c in R.PROFILE_COLUMNS])
    counts = (rows.select("gname", F.explode(feats).alias("feature")).filter(F.col("feature").isNotNull())
              .groupBy("gname", "feature").agg(F.count(F.lit(1)).alias("n")))
    return (counts.join(groups, "gname")
            .select("gname", "feature", (F.col("n") / F.col("incidents")).alias("weight")))


PART = 256      # groups of one part of a feature's postings
ANGLES = 4      # angle ranges within the largest angle that two similar groups may be apart


def similarity_edges(profiles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """N3 + N4: (g1, g2, similarity) for g1 < g2 with cosine >= threshold (exact, for thresholds above 0).

    Two similar groups share a feature of their prefixes (rarest features first, until what remains is too
    short to reach the threshold).  The postings of a prefix feature are cut into parts of about ``PART`` groups, and
    pairs of parts are the tasks: each multiplies two small matrices and passes on similar pairs
    only, so no feature's groups meet in one task and no candidate pair is ever a row.

    Parts hold a range of the angle between group and feature, acos(u).  The rest of a unit vector has length
    sqrt(1 - u^2), so a cosine is at most u1 u2 + sqrt(1 - u1^2) sqrt(1 - u2^2) = cos(angle1 - angle2): pairs of parts
    whose angles lie too far apart are left out.
    """
    norms = profiles.groupBy("gname").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    unit = (profiles.join(norms.filter(F.col("norm") > 0), "gname")
            .select("gname", "feature", (F.col("weight") / F.col("norm")).alias("u")))
    # global order: rarest feature first (a window over the distinct-feature table only)
    fdf = unit.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    forder = fdf.withColumn("frank", F.row_number().over(Window.orderBy("df", "feature")))
    ranked = unit.join(forder.select("feature", "frank"), "feature")
    # suffix mass from each feature on, within a group (window bounded by its feature count)
    w = Window.partitionBy("gname").orderBy(F.desc("frank")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = materialize(ranked.withColumn("suffix_sq", F.sum(F.col("u") ** 2).over(w)), "network-units")
    wide = math.acos(min(threshold, 1.0)) / ANGLES + 1e-7
    prefix = (ranked.filter(F.col("suffix_sq") >= threshold * threshold - 1e-12)
              .select("gname", "frank", F.floor(F.acos(F.least("u", F.lit(1.0))) / wide).alias("angle")))
    sizes = materialize(prefix.groupBy("frank", "angle").agg(F.count(F.lit(1)).alias("n")), "network-postings")
    shared = sizes.groupBy("frank").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("frank")
    sizes = sizes.join(shared, "frank", "left_semi").withColumn("parts", F.ceil(F.col("n") / PART))
    vectors = ranked.groupBy("gname").agg(F.collect_list(F.struct(F.col("frank").cast("long").alias("no"), "u")).alias("v"))
    parts = (prefix.join(sizes, ["frank", "angle"]).withColumn("part", F.pmod(F.xxhash64("gname"), F.col("parts")))
             .join(vectors, "gname").groupBy("frank", "angle", "part").agg(F.collect_list(F.struct("gname", "v")).alias("groups")))
    parts = materialize(parts, "network-parts")
    one, two = parts.select("frank", "angle", "part"), parts.select("frank", F.col("angle").alias("angle2"), F.col("part").alias("part2"))
    tasks = one.join(two, "frank").filter((F.col("angle2") >= F.col("angle")) & (F.col("angle2") - F.col("angle") <= ANGLES + 1)
                                          & ((F.col("angle2") > F.col("angle")) | (F.col("part2") >= F.col("part"))))
    tasks = (tasks.join(parts.withColumnRenamed("groups", "left"), ["frank", "angle", "part"])
             .join(parts.select("frank", F.col("angle").alias("angle2"), F.col("part").alias("part2"), F.col("groups").alias("right")),
                   ["frank", "angle2", "part2"]))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                names, matrix = zip(*(unit_rows(b.column(c)[k].values) for c in (0, 1)), strict=True)
                every = np.unique(np.concatenate([m[1] for m in matrix]))
                dense = [np.zeros((len(n), len(every))) for n in names]
                for d, (row, no, u) in zip(dense, matrix, strict=True):
                    d[row, np.searchsorted(every, no)] = u
                dots = dense[0] @ dense[1].T
                i, j = np.nonzero(dots >= threshold)
                pairs = [(min(x, y), max(x, y), d) for x, y, d in zip(names[0][i], names[1][j], dots[i, j], strict=True) if x != y]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs, strict=True)], names=["g1", "g2", "similarity"])

    found = tasks.select("left", "right").mapInArrow(multiply, "g1 string, g2 string, similarity double")
    return found.groupBy("g1", "g2").agg(F.max("similarity").alias("similarity"))     # pairs may share several features


def unit_rows(groups: pa.StructArray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names of a part's groups, and (row, feature, value) of their vectors."""
    lists = groups.field("v")
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    return np.array(groups.field("gname").to_pylist(), dtype=object), (row, np.asarray(flat.field("no")), np.asarray(flat.field("u")))


def network_nodes(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups on at least one edge (isolates dropped), sized by incidents."""
    ends = edges.select(F.col("g1").alias("gname")).union(edges.select(F.col("g2").alias("gname")))
    return groups.join(ends.distinct(), "gname", "left_semi")


def region_networks(df: DataFrame, threshold: float = 0.8, min_incidents: int = 50) -> DataFrame:
    """N6 for every region in one pass: (region_txt, g1, g2, similarity).

    A group's rows in one region are a group of their own, and features carry the region, so pairs
    of different regions share none.
    """
    mark = "\u0001"
    known = df.filter(F.col("gname").isNotNull() & (F.col("gname") != "Unknown") & F.col("region_txt").isNotNull())
    prof = group_profiles(known.withColumn("gname", F.concat_ws(mark, "region_txt", "gname")), min_incidents)
    prof = prof.withColumn("feature", F.concat(F.substring_index("gname", mark, 1), F.lit(mark), F.col("feature")))
    edges = similarity_edges(prof, threshold)
    return edges.select(F.substring_index("g1", mark, 1).alias("region_txt"), F.substring_index("g1", mark, -1).alias("g1"),
                        F.substring_index("g2", mark, -1).alias("g2"), "similarity")
