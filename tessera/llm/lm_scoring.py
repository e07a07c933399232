"""Operator 13: language-model scores of a log-bilinear neural model trained with noise contrast.

Tokens are the words of a text, A-Z lower-cased, and one end.  The model has ``CLASSES`` classes: the most
frequent words of the training documents, the end, and ``TAILS`` classes of all other words by their first two bytes.
With vectors r of the context classes, q of the predicted ones and position weights c,

    P(class | context) = softmax_class(q_class . sum_j c_j * r_(context j) + b_class)
    P(word of a tail class | class) = (c(word) + 1) / (sum of c + 1 over the class's words + 1)

where the last + 1 stands for the class's words that training never saw.  It is a normalised distribution: batches of
tokens give all class scores as one matrix product.

1. ``token_counts`` counts every token of the training documents (Spark adds up; the table stays in the shared folder).
2. ``train``: in each of ``ROUNDS`` rounds, tasks walk their share of the training documents (every document is in exactly
   one round) in small batches.  Each token is told apart from ``NOISE`` classes drawn by frequency (noise-contrastive
   estimation: the noise terms stand in for the normaliser), with Adagrad steps.  Spark averages the tasks'
   parameters, weighted by tokens and added as whole numbers, so that the sum's order can't change it.
3. ``score``: the counts of up to ``SENT`` words, all more frequent ones first, go to the tasks; counts of rarer words come by a join
   on the word, from which each document gets back one sum.

Words are told apart by 64-bit hashes: among a thousand million distinct words, the chance that any two share one is
about 3 %; among ten million about 3e-6.  Null and empty texts consist of the end alone.  Rows with a null id are learnt from.
Repeated rows are counted and scored each; without training documents every class is alike and every base score is 0.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, give_back, one_thread, table
from tessera.llm.words import hash_words, spans, utf8
from tessera.session import materialize

CLASSES, TAILS = 256, 192
PREFIX = 2                       # bytes of a rare word that decide its class
END = TAILS                      # class of the end; frequent words come after it
PAD = CLASSES                    # context before a text
CONTEXT, WIDTH = 3, 16
NOISE, BATCH = 64, 512
ROUNDS, RATE = 4, 0.15
SENT = 1 << 19                   # word counts that every task gets, at most
SCORED = 512                     # tokens whose class scores are computed at once
FIXED = 1 << 16                  # parameters are added up as whole multiples of 1 / FIXED


def left_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that are never learnt from: crc32 of the id modulo 7 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


class Tokens:
    """All tokens of some texts, laid end to end; each text's last one is its end."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = utf8(texts)
        first, last, borders = spans(data, offsets)
        word, prefix = hash_words(data, first, last, (PREFIX,))
        self.n = np.diff(borders) + 1
        self.borders = np.concatenate([[0], np.cumsum(self.n)])
        self.is_end = np.zeros(int(self.borders[-1]), dtype=bool)
        self.is_end[self.borders[1:] - 1] = True
        self.word = np.zeros(len(self.is_end), dtype=np.int64)
        self.word[~self.is_end] = word.view(np.int64)
        self.tail = np.full(len(self.is_end), END, dtype=np.int16)
        self.tail[~self.is_end] = (prefix % np.uint64(TAILS)).astype(np.int16)
        self.owner = np.repeat(np.arange(len(self.n)), self.n)

    def context(self, classes: np.ndarray) -> np.ndarray:
        """Classes of the ``CONTEXT`` tokens before each token, the nearest first."""
        out = np.full((CONTEXT, len(classes)), PAD, dtype=np.int16)
        place = np.arange(len(classes)) - np.repeat(self.borders[:-1], self.n)
        for j in range(1, CONTEXT + 1):
            out[j - 1, j:] = np.where(place[j:] >= j, classes[:-j], PAD)
        return out


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key among the sorted ones, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Vocabulary:
    """The frequent words' classes: sorted hashes and the class of each."""

    def __init__(self, words: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.number = words[order], (END + 1 + order).astype(np.int16)

    def classes(self, t: Tokens) -> np.ndarray:
        at, known = find(self.words, t.word)
        known &= ~t.is_end
        out = t.tail.copy()
        out[known] = self.number[at[known]]
        return out


class Model:
    """Parameters of the log-bilinear model; ``flat`` is one array of them all."""

    SHAPES = ((CLASSES, WIDTH), (CLASSES + 1, WIDTH), (CONTEXT, WIDTH), (CLASSES,))

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat
        parts, at = [], 0
        for s in self.SHAPES:
            parts.append(flat[at: at + int(np.prod(s))].reshape(s))
            at += int(np.prod(s))
        self.out, self.into, self.weight, self.bias = parts

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES)

    @classmethod
    def start(cls, share: np.ndarray) -> Model:
        """The unigram model: no context has an effect yet."""
        m = cls(np.zeros(cls.size(), dtype=np.float32))
        m.into[:] = np.random.default_rng(13).normal(0, 0.3, m.into.shape)
        m.weight[:] = (1 / np.arange(1, CONTEXT + 1))[:, None]
        m.bias[:] = np.log(share)
        return m

    def hidden(self, context: np.ndarray) -> np.ndarray:
        return sum(self.into[context[j]] * self.weight[j] for j in range(CONTEXT))

    def log10_probabilities(self, context: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token's class."""
        out = np.empty(len(classes))
        right = np.ascontiguousarray(self.out.T)
        longest, high = np.sqrt((self.out ** 2).sum(axis=1).max()), np.abs(self.bias).max()
        for lo in range(0, len(classes), SCORED):
            c = classes[lo: lo + SCORED]
            h = self.hidden(context[:, lo: lo + SCORED])
            z = h @ right
            z += self.bias
            if np.sqrt((h ** 2).sum(axis=1).max()) * longest + high > 60:      # only then could exp leave its range
                z -= z.max(axis=1, keepdims=True)
            own = z[np.arange(len(c)), c].copy()
            np.exp(z, out=z)
            out[lo: lo + SCORED] = own - np.log(z @ np.ones(CLASSES, dtype=z.dtype))
        return out / np.log(10)


def margins(m: Model, context: np.ndarray, classes: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hidden rows, and how far each token's class and the noise classes are above the noise.

    ``log_noise`` is log(number of noise classes * share).  The loss is that of telling the two apart:
    sum of log(1 + exp(-own)) and of log(1 + exp(other)).
    """
    h = m.hidden(context)
    return h, (m.out[classes] * h).sum(axis=1) + (m.bias - log_noise)[classes], h @ m.out[noise].T + (m.bias - log_noise)[noise]


def gradient(m: Model, context: np.ndarray, classes: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> Model:
    """The noise-contrastive loss's slope on a batch."""
    h, own, other = margins(m, context, classes, noise, log_noise)
    a = -1 / (1 + np.exp(np.clip(own, -30, 30)))
    b = 1 / (1 + np.exp(-np.clip(other, -30, 30)))
    g = Model(np.zeros_like(m.flat))
    gh = a[:, None] * m.out[classes] + b @ m.out[noise]
    add_rows(g.out, classes, a[:, None] * h)
    add_rows(g.out, noise, b.T @ h)
    g.bias += np.bincount(classes, weights=a, minlength=CLASSES) + np.bincount(noise, weights=b.sum(axis=0), minlength=CLASSES)
    for j in range(CONTEXT):
        add_rows(g.into, context[j], gh * m.weight[j])
        g.weight[j] = (m.into[context[j]] * gh).sum(axis=0)
    return g


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    place = at.astype(np.int64)[:, None] * to.shape[1] + np.arange(to.shape[1])
    to += np.bincount(place.ravel(), weights=rows.ravel(), minlength=to.size).reshape(to.shape)


def walk(m: Model, squares: np.ndarray, context: np.ndarray, classes: np.ndarray, share: np.ndarray, rng: np.random.Generator,
         rate: float = RATE) -> None:
    """Adagrad steps over a stretch of tokens, in place."""
    log_noise = np.log(share * NOISE).astype(np.float32)
    edges = np.cumsum(share)
    for lo in range(0, len(classes), BATCH):
        noise = np.minimum(np.searchsorted(edges, rng.random(NOISE)), CLASSES - 1)
        c = classes[lo: lo + BATCH]
        step = gradient(m, context[:, lo: lo + BATCH], c, noise, log_noise).flat / len(c)
        squares += step * step
        m.flat -= rate * step / np.sqrt(squares)


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, tail, n) of every token of ``text``; the end's word is null."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            t = Tokens(b.column(0))
            word, at, n = np.unique(t.word[~t.is_end], return_index=True, return_counts=True)
            tail = t.tail[~t.is_end][at]
            yield pa.RecordBatch.from_arrays([pa.array([*[None] * (b.num_rows > 0)], pa.int64()) if not len(word) else
                                              pa.concat_arrays([pa.array(word), pa.array([None], pa.int64())]),
                                              pa.array(np.append(tail, END) if b.num_rows else tail, pa.int32()),
                                              pa.array(np.append(n, b.num_rows) if b.num_rows else n, pa.int64())], names=["word", "tail", "n"])

    return docs.select("text").mapInArrow(count, "word long, tail int, n long").groupBy("word", "tail").agg(F.sum("n").alias("n"))


class Counts:
    """What tasks know of the counts: the words sent, classes, totals."""

    def __init__(self, counts: DataFrame, sent: int = SENT) -> None:
        known = counts.filter("word IS NOT NULL")
        size = F.floor(F.log2("n") * 16).cast("int")            # 16 steps to each doubling
        steps = sorted(((r["s"], r["k"]) for r in known.groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
        least, held = 1 << 30, 0
        for s, k in steps:
            if held + k > sent:
                break
            least, held = s, held + k
        total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.tokens, self.distinct = int(total[0] or 0), int(total[1])
        self.ends = int(counts.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0)
        got = known.filter(size >= least).select("word", "n").toPandas()     # at most ``sent`` words
        got = got.sort_values("word", ignore_index=True)
        self.word, self.n = got["word"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
        # classes of the most frequent words; where even equal counts don't fit, these words stay in their tails
        top = np.lexsort((self.word, -self.n))[:CLASSES - TAILS - 1]
        self.vocabulary = Vocabulary(self.word[top])
        self.rare = known.filter(size < least).select("word", "n")
        tails = {r["tail"]: r for r in known.groupBy("tail").agg(F.sum("n").alias("n"), F.sum(F.col("n") + 1).alias("mass")).collect()}
        self.mass, share = np.zeros(TAILS), np.zeros(CLASSES)
        for k, r in tails.items():
            self.mass[k], share[k] = r["mass"], r["n"]
        share[END] = self.ends
        share[END + 1: END + 1 + len(top)] = self.n[top]
        # what the frequent words hold of their tails comes off
        tail_of = {r["word"]: r["tail"] for r in known.filter(F.col("word").isin(self.word[top].tolist())).select("word", "tail").collect()}
        for w, n in zip(self.word[top].tolist(), self.n[top].tolist(), strict=True):
            share[tail_of[w]] -= n
            self.mass[tail_of[w]] -= n + 1
        self.share = (share + 1) / (share.sum() + CLASSES)


def train(docs: DataFrame, counts: Counts, rounds: int = ROUNDS, id_col: str = "doc_id") -> Model:
    """The model after walking each of ``docs`` once."""
    spark = docs.sparkSession
    m, squares = Model.start(counts.share), np.full(Model.size(), 1e-4, dtype=np.float32)
    part = F.pmod(F.xxhash64(F.col(id_col), F.length("text")), F.lit(rounds))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((m.flat, squares, counts.vocabulary, counts.share))

        def steps(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            give_back()
            one_thread()
            flat, squares, vocabulary, share = shared.value
            m, squares, seen = Model(flat.copy()), squares.copy(), 0
            rng = np.random.default_rng((k, TaskContext.get().partitionId()))
            for b in batches:
                t = Tokens(b.column(0))
                classes = vocabulary.classes(t)
                order = batch_order(t, rng)
                walk(m, squares, t.context(classes)[:, order], classes[order], share, rng)
                seen += len(classes)
            if seen:
                both = np.rint(np.concatenate([m.flat, squares]).astype(np.float64) * FIXED) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both) + 1)), pa.array(np.append(both, seen).astype(np.int64))],
                                                 names=["slot", "total"])

        got = (docs.filter(part == k).select("text").mapInArrow(steps, "slot long, total long")
               .groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("double").alias("total")).toPandas())  # one row a parameter
        shared.unpersist()
        if len(got):
            total = np.zeros(2 * Model.size() + 1)
            total[got["slot"].to_numpy(np.int64)] = got["total"]
            both = total[:-1] / total[-1] / FIXED
            m = Model(both[:Model.size()].astype(np.float32))
            squares = np.maximum(both[Model.size():], 1e-4).astype(np.float32)
    return m


def batch_order(t: Tokens, rng: np.random.Generator) -> np.ndarray:
    """Tokens in an order that mixes the texts: runs of 8 neighbours, shuffled."""
    runs = rng.permutation(-(-len(t.word) // 8))
    order = (runs[:, None] * 8 + np.arange(8)).ravel()
    return order[order < len(t.word)]


def score(docs: DataFrame, counts: Counts, model: Model) -> DataFrame:
    """``docs`` (doc_id, held_out, text) with n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    floor = np.log10(counts.tokens + counts.distinct + 1)
    shared = spark.sparkContext.broadcast((model.flat, counts.vocabulary, counts.word, np.log10(counts.n + 1.0), np.log10(counts.mass + 1),
                                           np.log10(counts.ends + 1.0), counts.ends > 0))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        one_thread()
        flat, vocabulary, words, log_n, log_mass, log_end, end_known = shared.value
        m = Model(flat)
        for b in batches:
            t = Tokens(b.column(3))
            classes = vocabulary.classes(t)
            docs_in = b.num_rows
            at, known = find(words, t.word)
            known &= ~t.is_end
            own = np.where(known, log_n.take(at) if len(words) else 0.0, 0.0)     # words not sent: their join adds it
            own[t.is_end] = log_end
            p = m.log10_probabilities(t.context(classes), classes)
            tail = classes < TAILS
            p[tail] += own[tail] - log_mass[classes[tail]]
            add = lambda x: np.bincount(t.owner, weights=x, minlength=docs_in)
            lost = ~known & ~t.is_end
            owner, word = t.owner[lost], t.word[lost]
            order = np.lexsort((word, owner))
            owner, word = owner[order], word[order]
            new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(word, prepend=0) != 0) | (np.arange(len(word)) == 0))
            n = np.diff(np.append(new, len(word)))
            cut = pa.array(np.searchsorted(owner[new], np.arange(docs_in + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(t.n), pa.array(add(known | t.is_end & end_known).astype(np.int64)),
                 pa.array(add(own) - floor * t.n), pa.array(add(p)), pa.ListArray.from_arrays(cut, pa.array(word[new])),
                 pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int32)))],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "times"])

    kind = dict(docs.dtypes)["doc_id"]
    first = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(
        scores, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
                "words array<long>, times array<int>"), "op13-scores")
    asked = first.select("row", F.explode(F.arrays_zip("words", "times")).alias("e")).select("row", F.col("e.words").alias("word"), "e.times")
    found = (asked.join(counts.rare, "word").groupBy("row")
             .agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_more")))
    more, known = F.coalesce("_more", F.lit(0.0)), F.coalesce("_known", F.lit(0))
    return (first.drop("words", "times").join(found, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
                    (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score")))


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """Train on the documents that are not left out and score all of them."""
    arrow_limits(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), left_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    learnt = docs.filter(~F.col("held_out"))
    counts = Counts(materialize(token_counts(learnt), "op13-counts"), sent)
    return score(docs, counts, train(learnt, counts)).withColumnRenamed("doc_id", id_col)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
