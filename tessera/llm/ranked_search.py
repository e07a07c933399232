"""Operator 12: ranked lexical search with hashed max-sketches.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.  With N documents that have a
term, L terms in all, n terms of a document, a term's weight w and its occurrences tf in the document, a document's score for an
item is the sum over the item's terms (repeats count) of

    w * impact      impact = 10**9 * tf div (1000 * tf + 12 * m)      m = 75 + 25 * n * N div L      w = floor(1000 * ln((2 N + 2) / (2 df + 1)))

``build_index`` writes a row per document: the sorted hashes of its terms with their tf, and its sketch.  A sketch has a power
of two of places, at least ``ROOM`` for each distinct term; a term's hash names its place, and a place keeps the largest impact of the terms
that meet there, rounded up to ``STEP``.  Items are asked in blocks.  For each batch of documents a task

1. looks up all the block's terms in all sketches at once: the weighted sums are upper bounds of the scores;
2. takes each item's documents in descending order of their bounds, scores them from the index, keeps the best ``k``, and stops
   where the next bound is below the k-th best score so far (an equal one is still scored: its id may be smaller).

Every task passes on ``k`` rows an item at most and Spark ranks these.  All arithmetic is in whole numbers.

Terms are told apart by 64-bit hashes: 10,000 terms asked against a thousand million distinct terms of the documents hold a wrong
match with a chance of about 5e-7.  Null and empty texts have no terms and are never found; items without terms find nothing.  Equal scores rank by
ascending id, null ids last.  Repeated rows rank each for itself.  Ids are whole numbers.  Extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, give_back, table
from tessera.llm.words import byte_set, hash_words, spans, utf8
from tessera.session import materialize

BETWEEN = ~byte_set(*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100))
TOP = 20
ROOM = 4                     # places of a sketch for each distinct term, at least
STEP = 4096                  # impacts are below 10**6 and kept in a byte, in steps of this size
ITEMS = 2048                 # items that are asked at once
AT_ONCE = 1 << 21            # bounds' summands that a task holds
ROUND = 32                   # documents an item scores before its threshold is looked at again
SALT = 64
NO_ID = np.iinfo(np.int64).max


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of the batch, and the border of each text's terms."""
    data, offsets = utf8(texts)
    first, last, borders = spans(data, offsets, BETWEEN)
    return hash_words(data, first, last)[0].view(np.int64), borders


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (10 ** 9 * tf) // (1000 * tf + 12 * m)


def lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The m of documents with n terms."""
    return np.array([75 + 25 * int(x) * docs // max(terms, 1) for x in n], dtype=np.int64)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms in all) of ``text``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            data, offsets = utf8(b.column(0))
            n = np.diff(spans(data, offsets, BETWEEN)[2])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])

    got = docs.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return int(got[0] or 0), int(got[1] or 0)


def binaries(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """Each stretch of ``values`` as one binary value."""
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer((borders * values.itemsize).astype(np.int64)), data]).cast(pa.binary())


def sketch(owner: np.ndarray, term: np.ndarray, impact: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sketches laid end to end, and their borders."""
    size = 1 << np.ceil(np.log2(np.maximum(distinct, 1) * ROOM)).astype(np.int64)
    borders = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(borders[-1]), dtype=np.uint8)
    np.maximum.at(out, borders[owner] + (term & (size[owner] - 1)), (-(-impact // STEP)).astype(np.uint8))
    return out, borders


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(index, N, L): a written table of (id, n, terms, times, sketch), a row for each document with a term."""
    arrow_limits(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    number, total = corpus_size(docs)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            term, borders = terms_of(b.column(1))
            n = np.diff(borders)
            owner = np.repeat(np.arange(b.num_rows), n)
            order = np.lexsort((term, owner))
            term, owner = term[order], owner[order]
            new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1]))) if len(term) else np.zeros(0, dtype=np.int64)
            tf = np.diff(np.append(new, len(term)))
            term, owner = term[new], owner[new]
            distinct = np.bincount(owner, minlength=b.num_rows)
            places, edges = sketch(owner, term, impacts(tf, lengths(n, number, total)[owner]), distinct)
            cuts = np.concatenate([[0], np.cumsum(distinct)])
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n), binaries(term, cuts), binaries(tf.astype(np.int32), cuts), binaries(places, edges)],
                                             names=["id", "n", "terms", "times", "sketch"])
            yield out.filter(pa.array(n > 0))

    index = docs.mapInArrow(entries, "id long, n long, terms binary, times binary, sketch binary")
    return materialize(index, "op12-index"), number, total


def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binaries, and each row's border in them."""
    column = column.cast(pa.large_binary())
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw.to_pybytes()[offsets[0]: offsets[-1]], dtype=kind), (offsets - offsets[0]) // size


class Block:
    """Some items' terms: the sorted distinct ones, and each item's as numbers with their repeats."""

    def __init__(self, texts: list[str | None]) -> None:
        term, borders = terms_of(pa.array(texts, pa.large_string()))
        self.terms, number = np.unique(term, return_inverse=True)
        held = [Counter(number[lo:hi].tolist()) for lo, hi in zip(borders[:-1], borders[1:], strict=True)]
        self.asked = [k for k, h in enumerate(held) if h]                       # items with a term
        self.number = np.array([t for k in self.asked for t in sorted(held[k])], dtype=np.int64)
        self.repeats = np.array([held[k][t] for k in self.asked for t in sorted(held[k])], dtype=np.int64)
        self.borders = np.concatenate([[0], np.cumsum([len(held[k]) for k in self.asked])]).astype(np.int64)

    def weigh(self, df: np.ndarray, docs: int) -> None:
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        self.weight = weight[self.number] * self.repeats


def document_frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    shared = index.sparkSession.sparkContext.broadcast(terms)           # a block's terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        df = np.zeros(len(shared.value), dtype=np.int64)
        for b in batches:
            term, _ = flat(b.column(0), np.int64)
            at = np.minimum(np.searchsorted(shared.value, term), len(df) - 1)
            df += np.bincount(at[shared.value[at] == term], minlength=len(df))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    out = np.zeros(len(terms), dtype=np.int64)
    if len(terms):
        got = index.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
        out[got["term"].to_numpy(np.int64)] = got["df"]
    shared.unpersist()
    return out


class Search:
    """A task's state: each item's best documents so far."""

    def __init__(self, block: Block, docs: int, terms: int, k: int) -> None:
        self.block, self.docs, self.terms, self.k = block, docs, terms, k
        self.score = np.zeros((len(block.asked), k), dtype=np.int64)
        self.id = np.full((len(block.asked), k), NO_ID, dtype=np.int64)
        self.scored = self.bounded = 0

    def look(self, ids: np.ndarray, n: np.ndarray, terms: pa.Array, times: pa.Array, sketches: pa.Array) -> None:
        """Go through a batch of index rows."""
        term, cuts = flat(terms, np.int64)
        tf, _ = flat(times, np.int32)
        places, edges = flat(sketches, np.uint8)
        m = lengths(n, self.docs, self.terms)
        rows = max(1, AT_ONCE // max(len(self.block.number), 1))
        for lo in range(0, len(ids), rows):
            hi = min(lo + rows, len(ids))
            bounds = self.bounds(places, edges[lo:hi + 1])
            self.bounded += bounds.size
            self.rescore(bounds, ids[lo:hi], m[lo:hi], term, tf, cuts[lo:hi + 1])

    def bounds(self, places: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Upper bound of every item's score in every document: (item, document)."""
        b = self.block
        at = edges[:-1, None] + (b.terms[None, :] & (np.diff(edges) - 1)[:, None])
        held = places.take(at)[:, b.number] * b.weight
        return np.add.reduceat(held, b.borders[:-1], axis=1).T * STEP

    def rescore(self, bounds: np.ndarray, ids: np.ndarray, m: np.ndarray, term: np.ndarray, tf: np.ndarray, cuts: np.ndarray) -> None:
        width = min(ROUND, len(ids))
        live = np.arange(len(bounds))
        while True:
            least = np.maximum(self.score[live, -1], 1)
            live = live[bounds[live].max(axis=1) >= least]
            if not len(live):
                return
            at = np.argpartition(-bounds[live], width - 1, axis=1)[:, :width]       # the highest bounds left
            high = np.take_along_axis(bounds[live], at, axis=1)
            wanted = high >= np.maximum(self.score[live, -1], 1)[:, None]
            item, doc = np.repeat(live, wanted.sum(axis=1)), at[wanted]
            got = np.zeros(at.shape, dtype=np.int64)
            got[wanted] = self.exact(item, doc, m, term, tf, cuts)
            self.scored += len(item)
            score = np.concatenate([self.score[live], got], axis=1)
            who = np.concatenate([self.id[live], np.where(got > 0, ids[at], NO_ID)], axis=1)
            order = np.lexsort((who, -score), axis=-1)[:, :self.k]
            self.score[live], self.id[live] = np.take_along_axis(score, order, axis=1), np.take_along_axis(who, order, axis=1)
            bounds[live[:, None], at] = -1

    def exact(self, item: np.ndarray, doc: np.ndarray, m: np.ndarray, term: np.ndarray, tf: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Scores of (item, document) pairs from the documents' terms."""
        b = self.block
        used, which = np.unique(doc, return_inverse=True)
        held = np.zeros((len(used), len(b.terms)), dtype=np.int64)
        for row, d in enumerate(used):
            mine = term[cuts[d]:cuts[d + 1]]
            at = np.minimum(np.searchsorted(b.terms, mine), len(b.terms) - 1)
            same = b.terms[at] == mine
            held[row, at[same]] = impacts(tf[cuts[d]:cuts[d + 1]][same].astype(np.int64), m[d])
        size = np.diff(b.borders)[item]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(b.borders[item], size)
        summands = held[np.repeat(which, size), b.number[place]] * b.weight[place]
        return np.add.reduceat(summands, ends - size) if len(size) else np.zeros(0, dtype=np.int64)


def best_documents(index: DataFrame, docs: int, terms: int, texts: list[str | None], k: int = TOP) -> DataFrame:
    """(item, rank, id, score): each item's ``k`` highest scores; ``item`` is the text's number in the list."""
    spark = index.sparkSession
    block = Block(texts)
    block.weigh(document_frequencies(index, block.terms), docs)
    shared = spark.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        s = Search(shared.value, docs, terms, k)
        for b in batches:
            s.look(np.asarray(b.column(0).fill_null(NO_ID)), np.asarray(b.column(1)), b.column(2), b.column(3), b.column(4))
        item, place = np.nonzero(s.score)
        who = s.id[item, place]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(s.block.asked, dtype=np.int64)[item]), pa.array(who, mask=who == NO_ID),
                                          pa.array(s.score[item, place])], names=["item", "id", "score"])

    if not block.asked:
        return spark.createDataFrame([], "item long, rank int, id long, score long")
    found = index.select("id", "n", "terms", "times", "sketch").mapInArrow(search, "item long, id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("id"))
    part = Window.partitionBy("item", "_salt").orderBy(*order)
    some = (found.withColumn("_salt", F.spark_partition_id() % SALT).withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return some.select("item", "id", "score").withColumn("rank", rank).filter(F.col("rank") <= k).select("item", "rank", "id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", k: int = TOP, at_once: int = ITEMS) -> DataFrame:
    """(item, rank, id, score) of each item's ``k`` best documents."""
    spark = docs.sparkSession
    index, number, total = build_index(docs, id_col, text_col)
    kind = dict(items.dtypes)[item_col]
    schema = f"{item_col} {kind}, rank int, {id_col} long, score long"
    rows = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).toLocalIterator()
    out = spark.createDataFrame([], schema)
    while block := list(islice(rows, at_once)):
        names = spark.createDataFrame([(k, r["item"]) for k, r in enumerate(block)], f"item long, _name {kind}")
        best = materialize(best_documents(index, number, total, [r["text"] for r in block], k), "op12-best")     # one block's broadcast at a time
        out = out.union(best.join(F.broadcast(names), "item").select(F.col("_name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""
OP12_SQL = f"""
WITH words AS (SELECT doc_id, {_TERMS} FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
    total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM len),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
    weight AS (SELECT item_id, term, times * CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN df USING (term), total),
    scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // l)))) AS BIGINT) AS score
               FROM weight JOIN tf USING (term) JOIN len USING (doc_id), total GROUP BY ALL),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
