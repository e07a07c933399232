"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize, release

BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: few rows and few bytes, so that a Python task's
    memory depends on its longest text and not on how many long texts meet in a batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


KEPT_BYTES = 1 << 20     # freed blocks from this size on go back to the system at once


_held: dict[str, dict] = {}


def give_back(keep: str = "") -> dict:
    """Let a Python worker drop and hand back memory: workers live on between stages, and what their
    allocators and operators kept would add up.

    Returns what the operator named ``keep`` remembers in this worker; all others' is dropped.  (The
    allocator's thresholds are for glibc; other libraries have no such setting.)
    """
    for name in [n for n in _held if n != keep]:
        del _held[name]
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-1, KEPT_BYTES)        # M_TRIM_THRESHOLD
        libc.mallopt(-3, KEPT_BYTES)        # M_MMAP_THRESHOLD
    return _held.setdefault(keep, {}) if keep else {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: rows (node, root), root = smallest node.

    Alternating large-star / small-star steps; every step is written to the shared folder,
    so a lost executor re-reads a table.  Only a row count and a changed-rows count reach
    the driver.  A hub's neighbours are never collected: both steps are a grouped minimum
    and an equi-join, which adaptive execution can split.
    """
    cur = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    cur = materialize(cur, "cc-edges")
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u hangs onto the smallest one
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = materialize(large, "cc-large")
        # small star: u and its smaller neighbours hang onto the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m")))
                                               .alias("e")).select("e.u", F.col("e.m").alias("v"))
                 .filter("u <> v").distinct())
        nxt = materialize(small, "cc-small")
        release(cur, large)
        # stars only: no root is itself a child and every child has one root
        roots = nxt.select(F.col("v").alias("u")).distinct()
        if (nxt.join(roots, "u", "left_semi").isEmpty()
                and nxt.groupBy("u").count().filter("count > 1").isEmpty()):
            child = nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return child.union(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
        cur = nxt


def held_out(doc_id: str = "doc_id"):
    """Every fifth document by crc32 of its id: labels of these are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``bound`` labelled documents to fit a classifier on, held-out ones excluded.

    The ids with the smallest hashes are taken; ``bound`` also bounds the broadcast.  Null labels
    and ids are left out; of repeated labels the largest counts.
    """
    known = (labels.select(F.col(id_col).alias("_id"), F.col(target).cast("int").alias("y"))
             .filter("_id IS NOT NULL AND y IS NOT NULL").filter(~held_out("_id"))
             .groupBy("_id").agg(F.max("y").alias("y"))
             .orderBy(F.xxhash64("_id"), "_id").limit(bound))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.join(F.broadcast(known), "_id").select("text", "y"), f"labelled-{target}")


def one_thread() -> None:
    """Let numpy's matrix products in this Python worker use one thread: Spark's tasks fill the cores already,
    and threads waiting for each other on small products cost more than the products.  (Where numpy's library is
    another one than OpenBLAS, nothing changes.)"""
    maps = Path("/proc/self/maps")
    found = {line.split()[-1] for line in maps.read_text().splitlines() if "openblas" in line} if maps.exists() else set()
    for lib in map(ctypes.CDLL, found):
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break
