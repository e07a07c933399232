"""Toxicity and quality: held-out accuracy, gradients, awkward rows."""

import math

import numpy as np
import pytest

from tessera.llm import quality, toxicity
from tessera.llm.queries import QUERIES
from tests.llm.brute import auc, held_out
from tests.llm.conftest import LARGE, ROWS, read


@pytest.mark.parametrize(("name", "column", "least"), [("op7_toxicity", 2, 0.95), ("op10_quality", 1, 0.98)])
def test_held_out_accuracy(spark, name, column, least):
    rows = {r.doc_id: r for r in QUERIES[name](spark, LARGE).collect()}
    assert len(rows) == 10_000
    limit = 0.5 if column == 2 else 0.3
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= limit) for r in rows.values())
    known = [(rows[x[0]], x[column]) for x in read(LARGE, "labels") if held_out(x[0])]
    assert auc([(r.score, y) for r, y in known]) >= least
    assert np.mean([r.predicted == y for r, y in known]) >= 0.97


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(0.3, rng.normal(size=6), rng.normal(size=(6, 3)), None)
    x = rng.random((4, 6)) * (rng.random((4, 6)) < 0.6)
    row, term = np.nonzero(x)
    pairs = [m.bias + r @ m.weights + sum(m.factors[i] @ m.factors[j] * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(m.raw(row, term, x[row, term], 4), pairs)


def test_machine_learns_an_interaction():
    """Neither term alone says anything; both together do."""
    rng = np.random.default_rng(5)
    x = (rng.random((600, 4)) < 0.5).astype(float)
    y = (x[:, 0] == x[:, 1]).astype(float)
    row, term = np.nonzero(x)
    m = toxicity.fit(row, term, x[row, term], y, None, 4)
    assert np.mean((toxicity.sigmoid(m.raw(row, term, x[row, term], 600)) > 0.5) == y) > 0.95


def test_attention_finds_the_passage_that_counts():
    """A bag's label is that of one passage among many."""
    rng = np.random.default_rng(6)
    size = rng.integers(1, 12, 400)
    cuts = np.concatenate([[0], np.cumsum(size)])
    x = rng.normal(size=(cuts[-1], quality.FEATURES))
    y = (rng.random(400) < 0.5).astype(float)
    for i in np.flatnonzero(y):
        x[cuts[i] + rng.integers(size[i]), 0] = 6
    x[:, 0] = np.where(x[:, 0] == 6, 6, np.minimum(x[:, 0], 2))
    bags = quality.Bags(x, cuts)
    model = quality.fit(bags, y)
    *_, weight, _, score = model.forward(bags)
    assert np.mean((score > 0.5) == y) > 0.95
    many = [i for i in np.flatnonzero(y) if size[i] > 4]
    assert np.mean([weight[cuts[i]:cuts[i + 1]].argmax() == x[cuts[i]:cuts[i + 1], 0].argmax() for i in many]) > 0.8


def tiny_bags(rng, documents):
    size = rng.integers(1, 6, documents)
    return quality.Bags(rng.normal(size=(size.sum(), quality.FEATURES)), np.concatenate([[0], np.cumsum(size)]))


def plain_score(model, passages):
    """The score of one document, passage by passage."""
    enc, enc0, v, u, w, c, c0 = model.theta
    hidden, weight = [], []
    for x in passages:
        h = np.tanh(np.clip((x - model.mean) / model.scale, -6, 6) @ enc + enc0)
        hidden.append(h)
        weight.append(math.exp(sum(w[g] * math.tanh(h @ v[:, g]) / (1 + math.exp(-(h @ u[:, g]))) for g in range(len(w)))))
    z = sum(a * h for a, h in zip(weight, hidden, strict=True)) / sum(weight)
    return 1 / (1 + math.exp(-(z @ c + c0[0])))


def test_attention_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(11)
    bags = tiny_bags(rng, 30)
    model = quality.fit(bags, (rng.random(30) < 0.5).astype(float), rounds=20)
    plain = [plain_score(model, bags.x[a:b]) for a, b in zip(bags.cuts[:-1], bags.cuts[1:], strict=True)]
    assert np.allclose(model.forward(bags)[-1], plain, atol=1e-12)


def test_attention_is_fitted_by_the_gradient_of_its_loss():
    """The same rounds of Adam by differences of the loss give the same model."""
    rng = np.random.default_rng(12)
    bags, y, rate, l2 = tiny_bags(rng, 12), np.tile([0.0, 1.0], 6), 0.03, 1e-4
    model = quality.fit(bags, y, rounds=0, rate=rate, l2=l2)
    theta = model.theta
    avg, square = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]

    def loss():
        p = model.forward(bags)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + l2 / 2 * sum((t ** 2).sum() for t in theta[:-1])

    for k in range(1, 7):
        slopes = []
        for t in theta:
            slope = np.zeros_like(t)
            for at in np.ndindex(t.shape):
                kept = t[at]
                t[at] = kept + 1e-5
                up = loss()
                t[at] = kept - 1e-5
                slope[at] = (up - loss()) / 2e-5
                t[at] = kept
            slopes.append(slope)
        for t, s, m, q in zip(theta, slopes, avg, square, strict=True):
            m += 0.1 * (s - m)
            q += 0.001 * (s * s - q)
            t -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(q / (1 - 0.999 ** k)) + 1e-8)
    fitted = quality.fit(bags, y, rounds=6, rate=rate, l2=l2)
    moved = max(np.abs(a - b).max() for a, b in zip(fitted.theta, quality.fit(bags, y, rounds=0).theta, strict=True))
    assert moved > 0.1
    for a, b in zip(fitted.theta, theta, strict=True):
        assert np.allclose(a, b, atol=2e-3)


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.scored])
def test_awkward_rows_and_empty_tables(awkward, labels, score):
    got = score(awkward, labels)
    assert set(got.columns) == set(awkward.columns)                 # the result's columns replace those of their name
    rows = got.select("doc_id", "text", "held_out", "score", "predicted").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    texts = {}
    for r in rows:
        assert texts.setdefault(r.text, r.score) == r.score          # nothing but the text counts
    assert score(awkward.limit(0), labels).count() == 0
    assert {round(r.score, 6) for r in score(awkward, labels.limit(0)).collect()} == {0.5}
    assert score(awkward, labels.selectExpr("doc_id", "1 AS quality", "1 AS toxic")).count() == len(ROWS)
