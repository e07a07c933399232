"""Operator 6: exact dedup over an extendible-hash index on shared files (DataFrame operations only).

1. Every row's normalised text gets a 64-bit key; rows (doc_id, key, digest) are written once, and
   the number of rows of each key.
2. The directory: from a histogram of keys over the finest key prefixes, overfull prefixes are
   split in two from depth 0 on; a bucket is the shortest prefix that holds at most ``capacity``
   keys.  Histogram and directory have at most 2**MAX_DEPTH rows whatever the corpus.
3. The directory routes texts to owner tasks: a task owns whole buckets, that is key ranges.  It
   compares the bytes of texts with equal keys; those that differ form the key's chain, in the order
   of their smallest doc_id.  Keeper and size of a group come from the chain's entry.  Texts of hot keys
   (``hot_keys``) are first combined where they are read, so that an owner receives few of their rows;
   each other text is moved once.
4. Every row looks up its chain entry by (key, digest).

Null text counts as empty; empty texts are equal to each other.  Ties: of equal texts the
smallest doc_id stays.  Repeated rows (same doc_id and text) are one group; each input row
gives an output row, and ``kept`` is true for all rows that carry the smallest doc_id.
A null doc_id is larger than any other.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.session import materialize

CAPACITY = 1 << 10     # keys that a bucket may hold
MAX_DEPTH = 20         # directory bits; a prefix that is still overfull stays one bucket
HOT_BYTES = 8 << 20    # a hot key's texts have more than this
HOT_SHARE = 1 << 16    # and more than this part of all bytes, so there are fewer hot keys than this
ROW_BYTES = 32         # a row beside its text


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """The directory (cell, depth, bucket) and its depth: a cell is a key prefix of that many bits.

    ``keys`` has one row for each key (column key).  Only overfull prefixes are split,
    so a bucket is the shortest prefix that holds at most ``capacity`` entries; the directory is
    as deep as its deepest bucket, and buckets of lesser depth stand in several cells.
    """
    cells = (keys.select(F.shiftrightunsigned("key", 64 - max_depth).alias("cell"))
             .groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    # every prefix of a used cell with its number of entries
    prefixes = (cells.select("n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"), "cell")
                .withColumn("prefix", F.expr(f"shiftright(cell, {max_depth} - depth)")))
    held = materialize(prefixes.groupBy("depth", "prefix").agg(F.sum("n").alias("held")), "dedup-prefixes")
    over = held.filter((F.col("held") > capacity) & (F.col("depth") < max_depth)).select("depth", "prefix")
    whole = held.join(over, ["depth", "prefix"], "left_anti")
    halves = over.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    buckets = whole.join(halves, ["depth", "prefix"], "left_semi").union(whole.filter("depth = 0")).select("depth", "prefix")
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    return buckets.select(F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - depth)") - 1)).alias("cell"),
                          "depth", first.alias("bucket")), depth


def hot_keys(counts: DataFrame, least: int = HOT_BYTES) -> DataFrame:
    """Repeated keys whose texts have more than ``least`` bytes and more than one in ``HOT_SHARE`` of all: fewer than
    ``HOT_SHARE`` keys.  So a hot key is one of many rows or of some long ones."""
    total = counts.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return counts.filter((F.col("rows") > 1) & (F.col("bytes") > max(least, total // HOT_SHARE))).select("key")


def owned_entries(texts: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """The index (bucket, depth, key, chain, text_sha256, keep_id, group_size) from ``texts`` (key, norm, keep_id,
    group_size), each a row or rows that were combined.

    One shuffle by bucket gives every owner whole buckets; grouping by bytes and chaining follow in the owner.
    """
    cell = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    # the directory has at most 2**MAX_DEPTH rows, whatever the corpus
    routed = texts.withColumn("cell", cell).join(F.broadcast(cells), "cell").repartition("bucket")
    entries = routed.groupBy("bucket", "depth", "key", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = entries.select("bucket", "depth", "key", F.sha2(F.col("norm"), 256).alias("text_sha256"), "keep_id", "group_size")
    chain = Window.partitionBy("bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "text_sha256")
    return entries.withColumn("chain", F.row_number().over(chain) - 1)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                max_depth: int = MAX_DEPTH, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket, chain) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("key", F.xxhash64("norm"))
    found = materialize(rows.select("doc_id", "key", F.sha2(F.col("norm"), 256).alias("text_sha256"),
                                    (F.octet_length("norm") + ROW_BYTES).cast("long").alias("bytes")), "dedup-rows")
    counts = materialize(found.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")), "dedup-keys")
    cells, depth = directory(counts.select("key"), capacity, max_depth)
    hot = materialize(hot_keys(counts, hot_bytes), "dedup-hot")
    one = rows.select("key", "norm", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    if not hot.isEmpty():
        hot = F.broadcast(hot)                 # fewer than HOT_SHARE keys
        combined = (one.join(hot, "key", "left_semi").groupBy("key", "norm")
                    .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
        one = one.join(hot, "key", "left_anti").unionByName(combined)
    index = materialize(owned_entries(one, cells, depth), "dedup-index")
    return (found.drop("bytes").join(index, ["key", "text_sha256"])
            .select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
