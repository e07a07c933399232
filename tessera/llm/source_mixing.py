"""Operator 4: mixing sources to target weights by Pfair scheduling.

Each source's documents, in id order, form blocks of ``BLOCK`` documents.  A source with weight w
(all weights sum to 1) owns block k in the window

    release  floor(k / w)    deadline  ceil((k + 1) / w)

of unit slots, and every slot goes to the released block with the earliest deadline.  As the
weights fill all slots, every block meets its window, so after any number of slots each source
that has not run out is less than one block away from its weight.  Weights are exact fractions and
windows whole-number arithmetic (a weight below 2**-40 of all counts as that, so that slots fit a
long).  One task walks the blocks of all sources in the order of their slots and writes the slots
down; it holds a few blocks of each source at a time, and its work grows with the blocks and not
with the slots.  A source that has run out leaves its slots idle and the others go on in proportion;
nothing is dropped or repeated.

With a given ``period`` the weights are rounded to whole shares of so many slots (largest remainders,
one share at least) and the schedule of one period repeats, sources that have run out included: less
than one block from the rounded shares, which stray from the weights with the number of slots.

Ranks within a source come from one range sort by (source, id), which spreads a large source over
many tasks, and the first position of each source in each range; nothing is ranked in one task.

Null sources count as the source ''.  Without given weights every source gets its share of the
documents to the power ``TEMPER``.  Given weights that are null, not positive or of no source are
left out; a source without a weight gets the smallest one given.  Rows that repeat a doc_id follow
each other; a null doc_id comes first.  Extra columns are kept, but for those with the names of
the result's own columns; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.session import materialize

BLOCK = 16           # documents
PERIOD = 1000        # slots, for shares of a period; at least four for each source
LEAST = Fraction(1, 1 << 40)
PLANNED = 1 << 16    # blocks in one batch of the plan
TEMPER = 0.5         # 1: sources by size, 0: all sources alike
MAX_SOURCES = 100_000
MIXED = ("mix_rank", "mix_block", "mix_release", "mix_deadline", "mix_slot")


def shares(weights: np.ndarray, period: int) -> np.ndarray:
    """Whole shares of ``period`` nearest to the weights (largest remainders), one at least."""
    if not len(weights):
        return np.zeros(0, dtype=np.int64)
    want = weights / weights.sum() * period
    out = np.maximum(np.floor(want).astype(np.int64), 1)
    while out.sum() != period:
        off = want - out
        step = 1 if out.sum() < period else -1
        order = np.lexsort((np.arange(len(off)), -step * off))
        order = order if step > 0 else order[out[order] > 1]
        out[order[: abs(period - int(out.sum()))]] += step
    return out


def schedule(share: np.ndarray, period: int) -> list[tuple[int, int, int]]:
    """One period by earliest deadline first: (source, block of the period, slot)."""
    release = sorted((k * period // int(a), s, k) for s, a in enumerate(share) for k in range(int(a)))
    out, ready, nxt = [], [], 0
    for slot in range(period):
        while nxt < len(release) and release[nxt][0] <= slot:
            _, s, k = release[nxt]
            heapq.heappush(ready, (-(-(k + 1) * period // int(share[s])), -int(share[s]), s, k))
            nxt += 1
        if ready:
            _, _, s, k = heapq.heappop(ready)
            out.append((s, k, slot))
    return out


def exact_shares(weights: list[float]) -> list[int]:
    """Whole numbers in the exact proportion of the weights, the least at least ``LEAST`` of all."""
    exact = [Fraction(w) for w in weights]
    floor = sum(exact) * LEAST
    exact = [max(w, floor) for w in exact]
    scale = max((w.denominator for w in exact), default=1)     # powers of two
    return [int(w * scale) for w in exact]


def run_plan(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """The whole run by earliest deadline first: (source, block, release, deadline, slot) in order of slots."""
    share = exact_shares(weights)
    total, slot, ready = sum(share), 0, []
    coming = [(0, s, 0) for s, n in enumerate(blocks) if n]
    heapq.heapify(coming)
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            release, s, k = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(k + 1) * total // share[s]), -share[s], s, k, release))
            if k + 1 < blocks[s]:
                heapq.heappush(coming, ((k + 1) * total // share[s], s, k + 1))
        deadline, _, s, k, release = heapq.heappop(ready)
        yield s, k, release, deadline, slot
        slot += 1


def planned(spark: SparkSession, known: list[tuple[str, float, int]], block: int) -> DataFrame:
    """(_source, mix_block, mix_release, mix_deadline, mix_slot) of every block, written by one task."""
    names, weights, blocks = [s for s, _, _ in known], [w for _, w, _ in known], [-(-n // block) for _, _, n in known]

    def plan(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def batch() -> pa.RecordBatch:
            s, *columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in s], pa.string()), *[pa.array(c, pa.int64()) for c in columns]],
                                              names=["_source", *MIXED[1:]])

        for row in run_plan(weights, blocks):
            rows.append(row)
            if len(rows) == PLANNED:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    schema = "_source string, " + ", ".join(f"{c} long" for c in MIXED[1:])
    return materialize(spark.range(0, 1, 1, 1).mapInArrow(plan, schema), "mix-plan")


def source_weights(docs: DataFrame, source_col: str, weights: DataFrame | None, temper: float) -> list[tuple[str, float, int]]:
    """(source, weight, documents) for every source; a catalogue of sources is small, and its size is checked."""
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is not None:
        given = (weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("double").alias("w"))
                 .filter("w > 0").groupBy("source").agg(F.max("w").alias("w")))
        sizes = sizes.join(given, "source", "left")
    else:
        sizes = sizes.withColumn("w", F.pow(F.col("n"), F.lit(temper)))
    rows = sizes.select("source", "w", "n").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    least = min((r["w"] for r in rows if r["w"]), default=1.0)
    return sorted((r["source"], float(r["w"] or least), r["n"]) for r in rows)


def _mixed(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source",
                block: int = BLOCK, period: int | None = None, temper: float = TEMPER) -> DataFrame:
    """(row, mix_rank, mix_block, mix_release, mix_deadline, mix_slot); ``row`` holds the document's columns."""
    spark = docs.sparkSession
    known = source_weights(docs, source_col, weights, temper)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"))
    keys = [F.col("_source"), F.col(f"row.{id_col}").asc_nulls_first()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # positions are kept with the rows: a range sort's borders may differ when it runs again
    rows = materialize(rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
                       .withColumn("_at", F.monotonically_increasing_id()), "mix-ranked")
    task = F.shiftrightunsigned("_at", 33)
    rows = rows.withColumn("_task", task)
    # a row for each source and range that holds it: as many as there are ranges and sources
    runs = rows.groupBy("_source", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    rows = rows.join(F.broadcast(runs), ["_source", "_task"]).withColumn("mix_rank", F.col("_at") + F.col("_before"))
    rows = rows.withColumn("mix_block", F.floor(F.col("mix_rank") / block))
    if period is None:
        return rows.join(planned(spark, known, block), ["_source", "mix_block"]).select("row", *MIXED)
    period = max(period, 4 * len(known))
    share = shares(np.array([w for _, w, _ in known]), period)
    plan = spark.createDataFrame([(known[s][0], k, slot, int(share[s])) for s, k, slot in schedule(share, period)],
                                 "_source string, _turn long, _slot long, _share long")
    by_source = plan.groupBy("_source").agg(F.max("_share").alias("_share"))
    rows = rows.join(F.broadcast(by_source), "_source").withColumn("_turn", F.col("mix_block") % F.col("_share"))
    rows = rows.join(F.broadcast(plan.drop("_share")), ["_source", "_turn"])    # a row for each slot of a period
    return rows.select(
        "row", "mix_rank", "mix_block", F.expr(f"mix_block * {period} div _share").alias("mix_release"),
        F.expr(f"((mix_block + 1) * {period} + _share - 1) div _share").alias("mix_deadline"),
        (F.expr("mix_block div _share") * period + F.col("_slot")).alias("mix_slot"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, **how) -> DataFrame:
    """``docs`` with mix_rank (in the source), mix_block, mix_release, mix_deadline and mix_slot."""
    return _mixed(docs, weights, **how).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in MIXED], *MIXED)


def in_mixed_order(docs: DataFrame, weights: DataFrame | None = None, **how) -> DataFrame:
    """``docs`` with its own columns, dealt out and sorted by slot: files written from it hold the mix."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["mix_slot", "mix_rank"]
    return _mixed(docs, weights, **how).repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("row.*")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "mix_rank", "mix_block", "mix_release", "mix_deadline", "mix_slot")
