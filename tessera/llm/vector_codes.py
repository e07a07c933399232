"""Operator 11: product codes of vectors, with a GNAT over each codebook.

Vectors become integers ``floor(1024 * x)`` and are cut into ``PARTS`` equal consecutive parts; a part is
coded by the nearest of up to ``ENTRIES`` codebook entries.  Codebooks start as the parts of the first
vectors by id and are refined ``ROUNDS`` times: tasks assign their vectors and add up sums per entry,
Spark adds these up, and only the sums (one row per entry and component) reach the driver.

Nearest entries come from a geometric near-neighbour access tree (``Gnat``): a node keeps split points and,
for every pair of a split point and a child, the range of distances from that point to all entries below
that child.  A query's distances to the split points rule out children whose range cannot hold anything
as near as the best entry so far.  Square roots are widened by more than their rounding error and a
child goes only if it is strictly farther, so ties reach the integer comparison, where the lower
index wins.

Rows whose vector is null, empty, or holds a null, NaN or infinity are dropped, and so are vectors of another
length than that of the smallest kept id.  A length that is no multiple of ``PARTS`` is filled up with zeros.
Integers beyond 2**24 count as 2**24 (both signs), so that sums of squares fit 64 bits up to 4096
components.  Equal or null ids are ordered by their vectors (null ids last); every row is coded.  With fewer than
``ENTRIES`` vectors the codebooks are shorter.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import give_back, one_thread, table
from tessera.session import materialize

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
LIMIT = 1 << 24
DEGREE, LEAF = 16, 24          # split points of a node, most entries of a leaf
AT_ONCE = 8192                 # vectors that are looked up together
LABELS_SENT = 100_000          # error sums of at most so many labels are broadcast
SALT = 32                      # copies of each sum beyond that
WIDER, NARROWER = 1 + 2.0 ** -50, 1 - 2.0 ** -50


def squared(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows: exact in doubles while all sums stay below 2**53, else in 64-bit integers."""
    top = max(np.abs(q).max(initial=0), np.abs(p).max(initial=0))
    if 4 * q.shape[1] * int(top) ** 2 < 1 << 53:
        q, p = q.astype(np.float64), p.astype(np.float64)
    return ((q * q).sum(axis=1)[:, None] - 2 * (q @ p.T) + (p * p).sum(axis=1)).astype(np.int64)


class Gnat:
    """Nearest of a few hundred integer points for many queries at once."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, leaf: int = LEAF) -> None:
        self.points, self.degree, self.leaf = points, degree, leaf
        self.looked = 0                                        # distances computed, for tests
        self.root = self._node(np.arange(len(points)))

    def _node(self, ids: np.ndarray) -> tuple:
        if len(ids) <= self.leaf:
            return ids, None, None, None
        # split points far from each other, the first by index
        all_d = squared(self.points[ids], self.points[ids])
        chosen = [0]
        far = all_d[0].copy()
        while len(chosen) < self.degree and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, all_d[chosen[-1]])
        if len(chosen) == 1:                                   # all points are the same
            return ids, None, None, None
        chosen = np.sort(chosen)
        rest = np.setdiff1d(np.arange(len(ids)), chosen)
        owner = all_d[rest][:, chosen].argmin(axis=1)
        low, high, children = np.zeros((len(chosen), len(chosen))), np.zeros((len(chosen), len(chosen))), []
        for j in range(len(chosen)):
            held = rest[owner == j]
            if len(held):
                d = np.sqrt(all_d[chosen][:, held].astype(np.float64))
                low[:, j], high[:, j] = d.min(axis=1) * NARROWER, d.max(axis=1) * WIDER
            children.append(self._node(ids[held]) if len(held) else None)
        return ids[chosen], low, high, children

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each query's nearest point (the lowest of equals) and the squared distance."""
        index = np.full(len(queries), len(self.points), dtype=np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        if len(queries):
            self._visit(self.root, queries, np.arange(len(queries)), index, best)
        return index, best

    def _visit(self, node: tuple, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        ids, low, high, children = node
        d2 = squared(queries[rows], self.points[ids])
        self.looked += d2.size
        at = d2.argmin(axis=1)                                  # ids ascend: the lowest of equals
        d, i = d2[np.arange(len(rows)), at], ids[at]
        better = (d < best[rows]) | (d == best[rows]) & (i < index[rows])
        best[rows[better]], index[rows[better]] = d[better], i[better]
        if children is None:
            return
        root = np.sqrt(d2.astype(np.float64))
        gap = np.empty((len(rows), len(children)))
        for j in range(len(children)):
            gap[:, j] = np.maximum(root * NARROWER - high[:, j], low[:, j] - root * WIDER).max(axis=1) * NARROWER
        for own in (True, False):                               # the nearest split's child first: it tightens the bound
            for j, child in enumerate(children):
                if child is not None:
                    here = np.flatnonzero((at == j) == own)
                    here = here[gap[here, j] <= np.sqrt(best[rows[here]].astype(np.float64)) * WIDER]
                    if len(here):
                        self._visit(child, queries, rows[here], index, best)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, keep: list[str]) -> DataFrame:
    """The rows whose vector is whole and finite, as ``q``: integers, clamped at ``LIMIT``."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    return (vectors.filter(x.isNotNull() & (F.size(x) > 0) & ~bad)
            .select(F.col(id_col).alias("id"), *[F.col(c).alias(f"_{c}") for c in keep], whole.alias("q")))


def matrix(column: pa.ListArray, length: int) -> np.ndarray:
    """Rows of integers, filled up to a multiple of PARTS, as (row, part, place)."""
    flat = np.asarray(column.flatten(), dtype=np.int64).reshape(-1, length)
    if length % PARTS:
        flat = np.pad(flat, ((0, 0), (0, -length % PARTS)))
    return flat.reshape(len(flat), PARTS, -1)


def in_lots(batches: Iterator[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[pa.Table]:
    """Batches joined to lots of about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def entry_sums(vectors: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """(part, entry, place) sums of the vectors assigned to each entry; place -1 is their number."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(books)              # PARTS * ENTRIES parts
    parts, entries, width = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        one_thread()
        trees = [Gnat(b) for b in shared.value]
        total = np.zeros((parts * entries, width + 1), dtype=np.int64)
        for lot in in_lots(batches):
            x = matrix(lot.column(0).chunk(0), length)
            for k in range(parts):
                code = trees[k].nearest(x[:, k])[0]
                order = np.argsort(code, kind="stable")
                begin = np.flatnonzero(np.diff(code[order], prepend=-1))
                at = k * entries + code[order][begin]
                total[at, :width] += np.add.reduceat(x[order, k], begin, axis=0)
                total[at, width] += np.diff(np.append(begin, len(code)))
        used = np.flatnonzero(total[:, width])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width + 1)), pa.array(np.tile(np.arange(width + 1), len(used))),
                                          pa.array(total[used].ravel())], names=["slot", "place", "total"])

    rows = (vectors.select("q").mapInArrow(add_up, "slot long, place long, total long")
            .groupBy("slot", "place").agg(F.sum("total").alias("total")).toPandas())
    shared.unpersist()
    out = np.zeros((parts * entries, width + 1), dtype=np.int64)
    out[rows["slot"], rows["place"]] = rows["total"]
    return out.reshape(parts, entries, width + 1)


def learn_codebooks(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """Codebooks (part, entry, place) of integer vectors, and their length (0: no vectors)."""
    first = vectors.select("id", "q").orderBy(F.asc_nulls_last("id"), "q").limit(entries).collect()
    if not first:
        return np.zeros((PARTS, 0, 0), dtype=np.int64), 0
    length = len(first[0]["q"])
    start = pa.array([r["q"] for r in first if len(r["q"]) == length], pa.list_(pa.int32()))
    books = matrix(start, length).transpose(1, 0, 2).copy()
    same = vectors.filter(F.size("q") == length)
    if len(start) < len(first):                                # other lengths among the first ones: look further
        more = same.orderBy(F.asc_nulls_last("id"), "q").limit(entries).collect()
        books = matrix(pa.array([r["q"] for r in more], pa.list_(pa.int32())), length).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = entry_sums(same, books, length)
        n = sums[:, :, -1:]
        books = np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books)
    return books, length


def encode(vectors: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """``code`` and ``error`` of each integer vector of that length."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        one_thread()
        trees = [Gnat(b) for b in shared.value]
        for lot in in_lots(batches):
            x = matrix(lot.column(2).chunk(0), length)
            found = [trees[k].nearest(x[:, k]) for k in range(PARTS)]
            code = np.stack([f[0] for f in found], axis=1)
            text = [bytes(c).hex() for c in code.astype(np.uint8)] if len(shared.value[0]) <= 256 else [",".join(map(str, c)) for c in code]
            yield pa.RecordBatch.from_arrays([lot.column(0).chunk(0), lot.column(1).chunk(0), pa.array(text, pa.string()),
                                              pa.array(sum(f[1] for f in found))], names=["id", "_label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return (vectors.filter(F.size("q") == length).select("id", "_label", "q")
            .mapInArrow(codes, f"id {kinds['id']}, _label {kinds['_label']}, code string, error long"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_group_sums(coded: DataFrame, most: int = LABELS_SENT) -> DataFrame:
    """``coded`` with ``label_error``, the sum of errors over equal labels (nulls are equal; null where it passes 64 bits).

    Few labels are broadcast after a count; else every label's sum is copied ``SALT`` times and rows are dealt over
    the copies, so that a frequent label is no single task's work.
    """
    sums = coded.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    sums = sums.select(F.col("_label").alias("_of"), F.expr("try_cast(label_error AS long)").alias("label_error"))
    if sums.limit(most + 1).count() <= most:
        return coded.join(F.broadcast(sums), F.col("_label").eqNullSafe(F.col("_of"))).drop("_of")
    salted = sums.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = coded.withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALT)).cast("int"))
    return rows.join(salted, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_copy"))).drop("_of", "_copy", "_salt")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of each kept vector."""
    whole = materialize(integer_vectors(vectors, id_col, vector_col, [label_col]).withColumnRenamed(f"_{label_col}", "_label"), "op11-vectors")
    books, length = learn_codebooks(whole)
    coded = materialize(encode(whole, books, length), "op11-codes")
    return with_group_sums(coded).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The whole algorithm without a tree: every part against every entry, four rounds unrolled."""
    assign = """
    a{r} AS MATERIALIZED (SELECT vec_id, label, pos, p, min(struct_pack(d := d, e := entry)) AS m FROM (
        SELECT v.vec_id, v.label, v.pos, v.p, b.entry, CAST(list_inner_product(v.p, v.p) - 2 * list_inner_product(v.p, b.p)
               + list_inner_product(b.p, b.p) AS BIGINT) AS d FROM parts v JOIN b{r} b ON v.pos = b.pos) GROUP BY ALL)"""
    update = """
    s{r} AS (SELECT pos, m.e AS entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT pos, m, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{r}) GROUP BY ALL),
    b{n} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(u.p, b.p) AS p FROM b{r} b LEFT JOIN (
        SELECT pos, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS p FROM s{r} GROUP BY pos, entry) u
        ON u.pos = b.pos AND u.entry = b.entry)"""
    steps = ",".join(assign.format(r=r) + "," + update.format(r=r, n=r + 1) for r in range(ROUNDS)) + "," + assign.format(r=ROUNDS)
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, label, pos, v[pos * (len(v) // {PARTS}) + 1 : (pos + 1) * (len(v) // {PARTS})] AS p
              FROM kept, range({PARTS}) t(pos)),
    b0 AS MATERIALIZED (SELECT pos, entry, p FROM (SELECT pos, p, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry FROM parts)
           WHERE entry < {ENTRIES}),{steps},
    hash AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos, entry, i)) AS h FROM (
        SELECT pos, entry, CAST(unnest(p) AS BIGINT) AS x, generate_subscripts(p, 1) AS i FROM b{ROUNDS})),
    coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY pos) AS code, CAST(sum(m.d) AS BIGINT) AS error
              FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, hash"""


OP11_SQL = _sql()
