"""As-of join: for each left row, the latest right row of the same key strictly before it.

Spark has no public as-of join.  Left and right rows are unioned and ordered inside
(key, time bucket) groups, where ``last(..., ignorenulls)`` finds the latest earlier
right row.  Left rows with no earlier right row in their own bucket take the last
right row of the latest earlier bucket, found by a running ``last`` over the
per-(key, bucket) table (one row per key and bucket).  No range join, and a hot key
is split by time into buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str,
              right_id: str, right_cols: list[str], bucket_seconds: int = 3600) -> DataFrame:
    """Left rows with ``right_id`` and ``right_cols`` of the latest right row (same key,
    right_time < left_time); NULLs when there is none.  Of right rows at one instant the one with
    the largest id is the latest."""
    rt = F.col(right_time).cast("timestamp")
    lt = F.col(left_time).cast("timestamp")
    payload = F.struct(F.col(right_time).cast("timestamp").alias("_t"), F.col(right_id).alias("_id"),
                       *[F.col(c) for c in right_cols])
    r = right.select(F.col(key).alias("_k"), rt.alias("_ts"), F.lit(0).alias("_side"), payload.alias("_p"))
    l_cols = left.columns
    lrow = left.select(F.col(key).alias("_k"), lt.alias("_ts"), F.lit(1).alias("_side"),
                       F.lit(None).cast(r.schema["_p"].dataType).alias("_p"), F.struct(*l_cols).alias("_l"))
    both = r.withColumn("_l", F.lit(None).cast(lrow.schema["_l"].dataType)).unionByName(lrow)
    both = both.withColumn("_b", F.floor(F.unix_timestamp("_ts") / bucket_seconds))
    # right rows at the same instant are not "before": order right after left at ties
    w = (Window.partitionBy("_k", "_b").orderBy("_ts", F.desc("_side"), F.col("_p._id"))
         .rowsBetween(Window.unboundedPreceding, -1))
    inside = both.withColumn("_prev", F.last("_p", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    per_bucket = (r.withColumn("_b", F.floor(F.unix_timestamp("_ts") / bucket_seconds))
                  .groupBy("_k", "_b").agg(F.max_by("_p", F.struct("_ts", F.col("_p._id"))).alias("_last")))
    # latest earlier bucket holding right rows: a running ``last`` over bucket summaries
    # and left-bucket markers (markers sort before the same bucket's summary)
    marks = inside.select("_k", "_b").distinct().select(
        "_k", "_b", F.lit(None).cast(per_bucket.schema["_last"].dataType).alias("_last"), F.lit(1).alias("_side"))
    u = per_bucket.withColumn("_side", F.lit(0)).unionByName(marks)
    wc = Window.partitionBy("_k").orderBy("_b", F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = (u.withColumn("_carry", F.last("_last", ignorenulls=True).over(wc))
               .filter(F.col("_side") == 1).select("_k", "_b", "_carry"))
    out = inside.join(earlier, ["_k", "_b"], "left").withColumn("_m", F.coalesce("_prev", "_carry"))
    return out.select("_l.*", F.col("_m._id").alias(right_id), *[F.col(f"_m.{c}").alias(c) for c in right_cols])
