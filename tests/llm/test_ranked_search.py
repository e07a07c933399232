"""Ranked search: every score against plain Python, bounds never below scores, awkward rows."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ranked_search as op
from tests.llm.conftest import MIDDLE, ROWS


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{MIDDLE}/{t}.parquet'")
    assert sorted(tuple(r) for r in op.op12_ranked_search(spark, MIDDLE).collect()) == sorted(con.execute(op.OP12_SQL).fetchall())


@pytest.mark.parametrize(("k", "at_once"), [(20, 2048), (3, 2)])
def test_awkward_rows(spark, awkward, bench, k, at_once):
    docs = awkward.withColumnsRenamed({"ids": "times", "start": "terms", "k": "sketch", "row": "n", "y": "item"})
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = op.ranked_search(docs, bench, k=k, at_once=at_once).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([(r[0], r[1]) for r in ROWS], items, k)
    assert op.ranked_search(docs.limit(0), bench).count() == 0 and op.ranked_search(docs, bench.limit(0)).count() == 0


def test_copies_rank_by_id(spark):
    """More equal copies than places, over many tasks."""
    rows = [(i, "alpha beta" if i % 3 else f"alpha gamma {i}") for i in range(999, -1, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    items = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma"), (3, "nowhere")], "item_id int, text string")
    got = sorted((tuple(r) for r in op.ranked_search(docs, items).collect()), key=repr)
    assert got == brute(rows, [(1, "alpha beta beta"), (2, "gamma")])


def test_bounds_hold_and_spare_work():
    """Collisions only raise a bound; most pairs are never scored."""
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 200), p=(p := 1 / np.arange(1, 5001)) / p.sum())) for _ in range(3000)]
    asked = [" ".join(t.split()[:12]) for t in texts[::100]]
    term, borders = op.terms_of(pa.array(texts))
    n = np.diff(borders)
    m = op.lengths(n, len(texts), int(n.sum()))
    rows = []
    for d in range(len(texts)):
        h, tf = np.unique(term[borders[d]:borders[d + 1]], return_counts=True)
        rows.append((h, tf.astype(np.int32), op.sketch(np.zeros(len(h), dtype=np.int64), h, op.impacts(tf, m[d]), np.array([len(h)]))[0]))
    block = op.Block(asked)
    held = Counter(t for h, _, _ in rows for t in h.tolist())
    block.weigh(np.array([held[t] for t in block.terms.tolist()]), len(texts))
    s = op.Search(block, len(texts), int(n.sum()), 20)
    places, edges = np.concatenate([r[2] for r in rows]), np.cumsum([0, *[len(r[2]) for r in rows]])
    cuts = np.cumsum([0, *[len(r[0]) for r in rows]])
    bounds = s.bounds(places, edges)
    item, doc = map(np.ravel, np.meshgrid(np.arange(len(asked)), np.arange(len(texts)), indexing="ij"))
    exact = s.exact(item, doc, m, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), cuts).reshape(bounds.shape)
    assert (bounds >= exact).all() and (bounds[exact > 0] < 1.5 * exact[exact > 0] + 6e9).mean() > 0.5
    binary = lambda c: pa.array([r[c].tobytes() for r in rows], pa.binary())
    s.look(np.arange(len(texts)), n, binary(0), binary(1), binary(2))
    assert s.score.tolist() == np.sort(exact, axis=1)[:, ::-1][:, :20].tolist()
    assert s.bounded == exact.size and s.scored < exact.size / 3
