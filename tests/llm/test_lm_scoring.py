"""Language-model scores: counts and base scores against plain Python, normalisation, the gradient, held-out gain."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lm_scoring as op
from tests.llm.brute import words
from tests.llm.conftest import MIDDLE, ROWS, SMALL, read

END = object()


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows):
    """[(id, held_out, n_tokens, n_known, train_tokens, base_score)]."""
    c = Counter(t for i, x in rows if not out(i) for t in [*words(x), END])
    n, v = sum(c.values()), len(c)
    return sorted(((i, out(i), len(w), sum(c[t] > 0 for t in w), n, round(sum(log10((c[t] + 1) / (n + v + 1)) for t in w), 6))
                   for i, x in rows for w in [[*words(x), END]]), key=repr)


def plain(df):
    return sorted(((r[0], r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df), key=repr)


@pytest.mark.parametrize("sent", [op.SENT, 2000, 0])
def test_base_scores(spark, sent):
    """However many counts are sent, the others come by the join; scores do not depend on it."""
    got = op.language_model_scores(spark.read.parquet(f"{SMALL}/documents.parquet"), sent=sent).collect()
    assert plain(got) == brute([(r[0], r[1]) for r in read(SMALL, "documents")])
    assert all(r.score < 0 for r in got)


def test_awkward_rows(spark, awkward):
    docs = awkward.withColumnsRenamed({"ids": "words", "start": "times", "k": "word", "y": "tail"})
    got = op.language_model_scores(docs).collect()
    assert plain(got) == brute([(r[0], r[1]) for r in ROWS])
    assert op.language_model_scores(docs.limit(0)).collect() == []
    untrained = next(i for i in range(99) if out(i))
    one = op.language_model_scores(spark.createDataFrame([(untrained, "a b")], "doc_id long, text string")).collect()[0]
    assert one.base_score == 0 and one.n_known == 0 and abs(one.score + 3 * log10(op.CLASSES)) < 1e-5


def random_model(seed=4, scale=0.5):
    return op.Model(np.random.default_rng(seed).normal(0, scale, op.Model.size()))


def test_probabilities_sum_to_one():
    m = random_model()
    context = np.random.default_rng(1).integers(0, op.CLASSES + 1, (op.CONTEXT, 5))
    for c in context.T:
        every = m.log10_probabilities(np.repeat(c[:, None], op.CLASSES, axis=1), np.arange(op.CLASSES))
        assert abs((10 ** every).sum() - 1) < 1e-9
    large = random_model(scale=8)                            # class scores beyond what exp takes
    every = large.log10_probabilities(np.zeros((op.CONTEXT, op.CLASSES), dtype=int), np.arange(op.CLASSES))
    assert np.isfinite(every).all() and abs((10 ** every).sum() - 1) < 1e-9


def test_words_of_a_class_sum_to_one(spark):
    """Over all words that training saw, and one for those it didn't, a tail class gives 1."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text")
    table = op.token_counts(docs)
    counts = op.Counts(table.cache())
    mass = Counter()
    for r in table.collect():
        if r.word is not None and r.word not in set(counts.vocabulary.words.tolist()):
            mass[r.tail] += r.n + 1
    assert [mass[k] for k in range(op.TAILS)] == counts.mass.tolist()
    assert abs(counts.share.sum() - 1) < 1e-9 and counts.tokens == sum(len(words(r[1])) + 1 for r in read(SMALL, "documents"))


def test_gradient():
    rng = np.random.default_rng(2)
    m, noise = random_model(), rng.integers(0, op.CLASSES, op.NOISE)
    context, classes = rng.integers(0, op.CLASSES + 1, (op.CONTEXT, 9)), rng.integers(0, op.CLASSES, 9)
    log_noise = np.log(rng.random(op.CLASSES))

    def loss(flat):
        _, own, other = op.margins(op.Model(flat), context, classes, noise, log_noise)
        return np.log1p(np.exp(-own)).sum() + np.log1p(np.exp(other)).sum()

    slope = op.gradient(m, context, classes, noise, log_noise).flat
    for at in rng.choice(np.flatnonzero(slope), 60, replace=False):
        step = np.zeros_like(m.flat)
        step[at] = 1e-5
        assert abs((loss(m.flat + step) - loss(m.flat - step)) / 2e-5 - slope[at]) < 1e-5


def test_contexts_stay_inside_texts():
    t = op.Tokens(pa.array(["a b c d", None, "e"]))
    got = t.context(np.arange(len(t.word), dtype=np.int16))
    assert t.n.tolist() == [5, 1, 2] and t.is_end.tolist() == [False] * 4 + [True, True, False, True]
    assert got[0].tolist() == [op.PAD, 0, 1, 2, 3, op.PAD, op.PAD, 6]
    assert got[2].tolist() == [op.PAD, op.PAD, op.PAD, 0, 1, op.PAD, op.PAD, op.PAD]


def test_training_helps_texts_it_never_saw(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", op.left_out().alias("held_out"), "text")
    learnt = docs.filter("NOT held_out")
    counts = op.Counts(op.materialize(op.token_counts(learnt), "counts"))
    rows = [op.score(docs, counts, m).filter("held_out").selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
            for m in (op.Model.start(counts.share), op.train(learnt, counts))]
    (start, base, n), (trained, _, _) = rows
    assert trained / n > start / n + 0.1 > base / n + 0.1
