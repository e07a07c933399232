"""Exact row positions in a total order without a single-partition window.

Rows are sorted once by ranges of the whole order (sampled, so that ranges hold about the same
number of rows whatever the values are) and written with their place in their range.
position = (rows of earlier ranges) + (place in the range); within partition columns, less the first
position of the partition.  The only window runs over one row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

RANGE_BITS = 33        # monotonically_increasing_id: the range above, the place in it below
PARTS_SENT = 100_000   # partitions whose first positions are broadcast
SALTS = 16


def ordered_position(df: DataFrame, day_cols: Sequence[str], id_col: str,
                     partition_cols: Sequence[str] = (), out: str = "pos") -> DataFrame:
    """Attach the 0-based position of each row in order (day_cols..., id_col) within
    ``partition_cols`` (ids must be unique within a partition).

    The sorted input is written once and read from there.  Neither a hot day, a hot partition nor an id
    far from all others makes a range large: the ranges split the whole order.
    """
    part, order = list(partition_cols), [*partition_cols, *day_cols, id_col]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(placed, "ordered-rows").withColumns({"_range": F.shiftright("_at", RANGE_BITS), "_place": F.col("_at").bitwiseAND((1 << RANGE_BITS) - 1)})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # a row for each range: as many as the sort has tasks; written, as whoever reads the rows reads it again
    rows = rows.join(F.broadcast(materialize(ranges.drop("_n"), "ordered-ranges")), "_range").withColumn(out, (F.col("_off") + F.col("_place")).cast("long")).drop("_at", "_range", "_place", "_off")
    if not part:
        return rows
    first = materialize(rows.groupBy(*part).agg(F.min(out).alias("_first")), "ordered-parts").withColumnsRenamed({c: f"_of_{c}" for c in part})
    first = F.broadcast(first) if first.limit(PARTS_SENT + 1).count() <= PARTS_SENT else first
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in part])
    return rows.join(first, same).withColumn(out, F.col(out) - F.col("_first")).drop("_first", *[f"_of_{c}" for c in part])


def grouped_median(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Exact median of each of ``cols`` per ``key`` (the mean of the two middle values).

    Values are counted first (combined in every task); whole-number buckets of the values tell in
    which bucket a middle rank lies, and only that bucket's values are ranked.  No task holds
    all values of a hot key.
    """
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x"))
    counts = materialize(long.filter("x.v IS NOT NULL").groupBy(key, F.col("x.c").alias("c"), F.col("x.v").alias("v"))
                         .agg(F.count(F.lit(1)).alias("n")), "median-counts").withColumn("b", F.floor("v"))
    up = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    buckets = counts.groupBy(key, "c", "b").agg(F.sum("n").alias("bn"))
    buckets = buckets.withColumn("upto", F.sum("bn").over(up([key, "c"], "b")))
    total = buckets.groupBy(key, "c").agg(F.max("upto").alias("all"))
    ranks = total.select(key, "c", F.explode(F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2))).alias("rank"))
    holds = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("bn"))
    middle = buckets.join(ranks, [key, "c"]).filter(holds).select(key, "c", "b", "rank", (F.col("upto") - F.col("bn")).alias("before"))
    inside = (counts.join(middle.select(key, "c", "b").distinct(), [key, "c", "b"], "left_semi")
              .withColumn("upto", F.sum("n").over(up([key, "c", "b"], "v"))))
    found = (inside.join(middle, [key, "c", "b"])
             .filter((F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n"))))
    medians = found.groupBy(key, "c").agg((F.min("v") * 0.5 + F.max("v") * 0.5).alias("median"))
    pick = [F.max(F.when(F.col("c") == c, F.col("median"))).alias(c) for c in cols]
    return medians.groupBy(key).agg(*pick)


def top_k(df: DataFrame, part: list[str], order: list[Column], k: int, salt_col: str) -> DataFrame:
    """Top ``k`` rows per ``part`` by ``order`` in two stages (per salt, then per part).

    Stage one keeps at most ``k`` rows per (part, salt), so a hot part reaches the
    final window with at most ``k * SALTS`` rows, never its whole group.
    """
    salted = df.withColumn("_salt", F.abs(F.xxhash64(salt_col)) % SALTS)
    w1 = Window.partitionBy(*part, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*part).orderBy(*order)
    return stage1.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)
