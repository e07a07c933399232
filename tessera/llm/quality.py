"""Operator 10: document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only the document has a label.  Every
passage is described by its shape (letters, digits, marks, capitals, repeats, word lengths),
encoded by a hidden layer, weighted by gated attention

    h_k = tanh(E x_k + e)      a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k)))

and the score is the logistic function of a linear form of the weighted passage
representation sum_k a_k h_k.  All layers are learnt together from document labels, on at most
``SAMPLE`` labelled documents with at most ``BAG`` passages each, evenly spaced (fitting only:
scores use every passage of the whole text).

Scores are in 0..1 for any text; null and empty texts are a bag with one passage without words.
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
from tessera.llm.toxicity import sigmoid
from tessera.llm.words import byte_set, hash_words, spans, utf8

PASSAGE = 64               # words
SAMPLE = 3_000             # labelled documents to fit on, at most
BAG = 256                  # passages of a document to fit on, at most
HIDDEN, GATE = 16, 8
ROUNDS = 200
THRESHOLD = 0.3

# kinds of bytes inside words
KINDS = (byte_set(*range(0x61, 0x7B)), byte_set(*range(0x41, 0x5B)), byte_set(*range(0x30, 0x3A)), byte_set(*range(0x80, 0x100)),
         byte_set(*b".,;:"), byte_set(*b"!?"), byte_set(*b"#$%&*"), byte_set(*b"|"), byte_set(*b"'\"()-"))
N_KINDS = len(KINDS) + 1   # and all other bytes
FEATURES = N_KINDS + 8


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the border of each text's passages (one at least)."""
    data, offsets = utf8(texts)
    first, last, borders = spans(data, offsets)
    n = np.diff(borders)
    many = np.maximum(-(-n // PASSAGE), 1)
    cuts = np.concatenate([[0], np.cumsum(many)])
    total = int(cuts[-1])
    out = np.zeros((total, FEATURES))
    if len(first):
        # passage of each word
        which = np.repeat(cuts[:-1], n) + (np.arange(len(first)) - np.repeat(borders[:-1], n)) // PASSAGE
        size = last - first
        count = np.bincount(which, minlength=total)
        held = np.maximum(count, 1)
        letters = np.bincount(which, weights=size, minlength=total)
        # bytes of each kind from running counts; white space is of no kind
        begin = np.flatnonzero(np.diff(which, prepend=-1))
        end = np.append(begin[1:], len(first)) - 1
        for k, kind in enumerate(KINDS):
            run = np.concatenate([[0], np.cumsum(kind.take(data), dtype=np.uint32)])
            out[which[begin], k] = (run[last[end]] - run[first[begin]]) / letters[which[begin]]
        out[which[begin], N_KINDS - 1] = 1 - out[which[begin], :N_KINDS - 1].sum(axis=1)
        h = hash_words(data, first, last)[0]
        order = np.lexsort((h, which))
        sw, sh = which[order], h[order]
        new = np.ones(len(sh), dtype=bool)
        new[1:] = (sw[1:] != sw[:-1]) | (sh[1:] != sh[:-1])
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (which[1:] == which[:-1])
        mean = letters / held
        out[:, N_KINDS] = np.bincount(sw[new], minlength=total) / held                       # distinct words
        out[:, N_KINDS + 1] = np.bincount(which[again], minlength=total) / held              # a word twice running
        out[:, N_KINDS + 2] = np.log1p(mean)
        out[:, N_KINDS + 3] = np.log1p(np.sqrt(np.maximum(np.bincount(which, weights=size.astype(float) ** 2, minlength=total) / held - mean ** 2, 0)))
        out[:, N_KINDS + 4] = np.bincount(which[size == 1], minlength=total) / held          # words of one byte
        out[:, N_KINDS + 5] = np.bincount(which[size > 20], minlength=total) / held          # very long words
        out[:, N_KINDS + 6] = np.log1p(count) / np.log1p(PASSAGE)
    out[:, N_KINDS + 7] = np.log1p(np.repeat(n, many)) / 8
    return out, cuts


class Bags:
    """Passage features of many documents, laid end to end."""

    def __init__(self, x: np.ndarray, cuts: np.ndarray) -> None:
        self.x, self.cuts = x, cuts
        self.owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))


class AttentionModel:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, theta: list[np.ndarray]) -> None:
        self.mean, self.scale, self.theta = mean, scale, theta

    def forward(self, bags: Bags) -> tuple:
        enc, enc0, v, u, w, c, c0 = self.theta
        x = np.clip((bags.x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ enc + enc0)
        tv, su = np.tanh(h @ v), sigmoid(h @ u)
        e = (tv * su) @ w
        e = np.exp(e - np.maximum.reduceat(e, bags.cuts[:-1])[bags.owner])
        a = e / np.add.reduceat(e, bags.cuts[:-1])[bags.owner]
        z = np.add.reduceat(a[:, None] * h, bags.cuts[:-1], axis=0)
        return x, h, tv, su, a, z, sigmoid(z @ c + c0[0])

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.forward(Bags(*passages(texts)))[-1] if len(texts) else np.zeros(0)


def fit(bags: Bags, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.03, l2: float = 1e-4) -> AttentionModel:
    """Logistic loss by full-batch Adam; the gradient goes back through attention and encoder."""
    rng, n = np.random.default_rng(10), len(y)
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    shapes = [(FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
    theta = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k == 4 else np.zeros(s) for k, s in enumerate(shapes)]
    theta[6][0] = np.log(share / (1 - share))
    mean = bags.x.mean(axis=0) if len(bags.x) else np.zeros(FEATURES)
    scale = bags.x.std(axis=0) + 1e-3 if len(bags.x) else np.ones(FEATURES)
    model = AttentionModel(mean, scale, theta)
    if not n or y.min() == y.max():
        return model
    avg, square = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for k in range(1, rounds + 1):
        enc, enc0, v, u, w, c, c0 = theta
        x, h, tv, su, a, z, p = model.forward(bags)
        g = (p - y) / n
        gz = g[:, None] * c
        gh = a[:, None] * gz[bags.owner]
        ga = (h * gz[bags.owner]).sum(axis=1)                        # through the attention weights
        ge = a * (ga - np.add.reduceat(a * ga, bags.cuts[:-1])[bags.owner])
        gt = ge[:, None] * w
        gv, gu = gt * su * (1 - tv ** 2), gt * tv * su * (1 - su)
        gh += gv @ v.T + gu @ u.T
        gx = gh * (1 - h ** 2)
        slope = [x.T @ gx, gx.sum(axis=0), h.T @ gv, h.T @ gu, (tv * su).T @ ge, z.T @ g, np.array([g.sum()])]
        for t, s, m, q in zip(theta, slope, avg, square, strict=True):
            s = s + l2 * t * (t is not c0)
            m += 0.1 * (s - m)
            q += 0.001 * (s * s - q)
            t -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(q / (1 - 0.999 ** k)) + 1e-8)
    return model


def fit_model(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> AttentionModel:
    rows = labelled_sample(docs, labels, target, sample)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cuts = passages(b.column(0))
            kept = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = np.arange(lo, hi) if hi - lo <= BAG else np.linspace(lo, hi - 1, BAG).astype(np.int64)
                kept.append(x[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(kept, pa.binary())], names=["y", "x"])

    # at most SAMPLE * BAG passages; the row order must not change the fit
    got = rows.select("text", "y").mapInArrow(describe, "y int, x binary").orderBy("y", "x").toPandas()
    x = [np.frombuffer(r, "<f4").reshape(-1, FEATURES) for r in got["x"]]
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in x])]).astype(np.int64)
    return fit(Bags(np.concatenate([np.zeros((0, FEATURES)), *x]), cuts), got["y"].to_numpy(float))


def score_column(docs: DataFrame, labels: DataFrame, target: str = "quality", text_col: str = "text") -> F.Column:
    """Fit on ``docs`` and ``labels``; the score of each text as a column."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(fit_model(docs, labels, target))      # a few hundred weights

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back()
        for batch in texts:
            yield pd.Series(shared.value.scores(pa.array(batch, pa.large_string(), from_pandas=True)))

    return score(F.col(text_col).cast("string"))


def scored(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    return (docs.withColumn("held_out", held_out()).withColumn("score", score_column(docs, labels, target))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    return docs.filter(score_column(docs, labels) >= threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
