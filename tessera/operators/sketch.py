"""Distinct counts that add up: sketches stored per day, united over any span.

A sketch (HyperLogLog, Spark's ``hll_sketch_agg``) is a few kilobytes whatever it has seen, so a store of one per key and
day answers any span without reading rows again.  With ``lg`` = 12 the standard error is about 1.6 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG = 12


def stored_sketches(df: DataFrame, keys: list[str], time: str, value: str, lg: int = LG) -> DataFrame:
    """(keys, time, sketch): one sketch of ``value`` for each key and time; null values are not counted."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, time)
            .agg(F.hll_sketch_agg(value, F.lit(lg)).alias("sketch")))


def distinct_over(sketches: DataFrame, spans: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(keys, from_, to_, estimate) of each key and each row (from_, to_) of ``spans``, both ends included.

    A span is exploded to its times first, so the join is an equi-join on the time.
    """
    days = spans.withColumn(time, F.explode(F.sequence("from_", "to_")))
    return (sketches.join(days, time).groupBy(*keys, "from_", "to_")
            .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")))
