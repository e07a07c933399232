"""Operator 7: toxicity scores of a factorisation machine over hashed terms.

Terms are runs of letters and digits, lower-cased, and their first 4 to 7 bytes (stems), hashed to
``DIMS`` places.  The value of a term is the square root of its count over the fourth root of the
document's number of terms.  The model is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so that two terms can weigh more together than each alone.  It is fitted on at most ``SAMPLE``
labelled documents: from counts over these, the ``TERMS`` places that tell the classes apart best
are kept, then weights and factors are found by full-batch Adam with L2 penalties.

Scores are in 0..1 for any text; null and empty texts have no terms and get the bias alone.
Without labels, or with one class only, every score is the sample's share of label 1 (0.5 without
any).  Repeated rows are scored each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, give_back, held_out, labelled_sample, table
from tessera.llm.words import byte_set, hash_words, spans, utf8

DIMS = 1 << 18
STEMS = (4, 5, 6, 7)       # bytes
SAMPLE = 20_000            # labelled documents to fit on, at most
TERMS = 1024               # places that the model keeps
RANK = 8
ROUNDS = 300
THRESHOLD = 0.5
BETWEEN = ~byte_set(*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100))


def term_counts(texts: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, count) of the batch's terms, sorted, and each row's number of terms.

    ``keep`` maps places to the model's numbers, or -1.
    """
    data, offsets = utf8(texts)
    first, last, borders = spans(data, offsets, BETWEEN)
    total = np.diff(borders)
    word_row = np.repeat(np.arange(len(texts)), total)
    rows, places = [], []
    for kind, h in enumerate(hash_words(data, first, last, STEMS)):
        place = ((h ^ np.uint64(kind * 0x9E37)) >> np.uint64(7)).astype(np.int64) & (DIMS - 1)
        row = word_row
        if kind:                                    # shorter words have no stem
            longer = last - first > STEMS[kind - 1]
            row, place = row[longer], place[longer]
        if keep is not None:
            place = keep.take(place)
            row, place = row[place >= 0], place[place >= 0]
        rows.append(row)
        places.append(place)
    both = np.concatenate(rows) * DIMS + np.concatenate(places)
    both, count = np.unique(both, return_counts=True)
    return both // DIMS, both % DIMS, count, total


def values(row: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.sqrt(count) / (np.maximum(total, 1) ** 0.25)[row]


def class_counts(sample: DataFrame) -> DataFrame:
    """(place, n, pos): documents of the sample that have a term, and those of label 1 among them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pos = np.zeros(DIMS, dtype=np.int64), np.zeros(DIMS, dtype=np.int64)
        for b in batches:
            row, place, _, _ = term_counts(b.column(0))
            y = np.asarray(b.column(1))[row] == 1
            n += np.bincount(place, minlength=DIMS)
            pos += np.bincount(place[y], minlength=DIMS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(pos[used])], names=["place", "n", "pos"])

    return (sample.select("text", "y").mapInArrow(count, "place long, n long, pos long")
            .groupBy("place").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))


def best_terms(counts: pd.DataFrame, docs: int, toxic: int, terms: int = TERMS, least: int = 3) -> np.ndarray:
    """Places by the chi-square of having the term against the label, best first."""
    n, pos = counts["n"].to_numpy(float), counts["pos"].to_numpy(float)
    want = n * toxic / docs
    score = (pos - want) ** 2 / np.maximum(want * (1 - toxic / docs), 1e-9)
    score = np.where(n >= least, score / np.maximum(1 - n / docs, 1e-9), -1.0)
    order = np.lexsort((counts["place"].to_numpy(), -score))
    order = order[score[order] > 0][:terms]
    return counts["place"].to_numpy()[order]


class Machine:
    """A factorisation machine; rows come as (row, term, value) triples sorted by row."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray, keep: np.ndarray) -> None:
        self.bias, self.weights, self.factors, self.keep = bias, weights, factors, keep

    def raw(self, row: np.ndarray, term: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias) + np.bincount(row, weights=self.weights[term] * x, minlength=n)
        for v in self.factors.T:
            part = v[term] * x
            out += 0.5 * (np.bincount(row, weights=part, minlength=n) ** 2 - np.bincount(row, weights=part ** 2, minlength=n))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, term, count, total = term_counts(texts, self.keep)
        return sigmoid(self.raw(row, term, values(row, count, total), len(texts)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(row: np.ndarray, term: np.ndarray, x: np.ndarray, y: np.ndarray, keep: np.ndarray, terms: int,
        rank: int = RANK, rounds: int = ROUNDS, rate: float = 0.05, l2: float = 1e-5) -> Machine:
    """Logistic loss by full-batch Adam."""
    n, rng = len(y), np.random.default_rng(7)
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(terms), np.zeros((terms, rank)), keep)
    if n and 0 < y.mean() < 1 and terms:
        m.factors = rng.normal(0, 0.05, (terms, rank))
        theta = [np.array([m.bias]), m.weights, m.factors]
        mean, square = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        for k in range(1, rounds + 1):
            parts = m.factors[term] * x[:, None]
            sums = np.stack([np.bincount(row, weights=p, minlength=n) for p in parts.T], axis=1)
            z = theta[0][0] + np.bincount(row, weights=m.weights[term] * x, minlength=n)
            z += 0.5 * ((sums ** 2).sum(axis=1) - np.bincount(row, weights=(parts ** 2).sum(axis=1), minlength=n))
            g = (sigmoid(z) - y) / n
            gx = g[row] * x
            step = sums[row] - parts
            slope = [np.array([g.sum()]), np.bincount(term, weights=gx, minlength=terms) + l2 * m.weights,
                     np.stack([np.bincount(term, weights=gx * s, minlength=terms) for s in step.T], axis=1) + l2 * m.factors]
            for t, s, a, b in zip(theta, slope, mean, square, strict=True):
                a += 0.1 * (s - a)
                b += 0.001 * (s * s - b)
                t -= rate * (a / (1 - 0.9 ** k)) / (np.sqrt(b / (1 - 0.999 ** k)) + 1e-8)
        m.bias = float(theta[0][0])
    return m


def fit_machine(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> Machine:
    rows = labelled_sample(docs, labels, target, sample)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    counts = class_counts(rows).toPandas()                    # DIMS rows at most
    chosen = best_terms(counts, max(size["n"], 1), size["pos"] or 0, terms) if len(counts) else np.zeros(0, dtype=np.int64)
    keep = np.full(DIMS, -1, dtype=np.int64)
    keep[chosen] = np.arange(len(chosen))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term, count, total = term_counts(b.column(0), keep)
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            lists = lambda v: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v))
            yield pa.RecordBatch.from_arrays([b.column(1), lists(term), lists(values(row, count, total))], names=["y", "term", "x"])

    # the sample's terms among the chosen ones; the row order must not change the fit
    got = rows.select("text", "y").mapInArrow(vectors, "y int, term array<long>, x array<double>").orderBy("y", "term", "x").toPandas()
    length = got["term"].map(len).to_numpy() if len(got) else np.zeros(0, dtype=np.int64)
    flat = lambda c: np.concatenate([np.zeros(0), *got[c]])
    return fit(np.repeat(np.arange(len(got)), length), flat("term").astype(np.int64), flat("x"), got["y"].to_numpy(float), keep, len(chosen))


def toxicity_scores(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(fit_machine(docs, labels, target))     # TERMS weights and factors

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back()
        for batch in texts:
            yield pd.Series(shared.value.scores(pa.array(batch, pa.large_string(), from_pandas=True)))

    return (docs.withColumn("held_out", held_out()).withColumn("score", score(F.col("text").cast("string")))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
