"""Vector codes: the tree against every entry, the whole algorithm against plain Python, awkward rows."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import vector_codes as op
from tests.llm.conftest import MIDDLE


def plain_nearest(q, p):
    d = ((q[:, None, :].astype(object) - p[None].astype(object)) ** 2).sum(axis=2)
    best = [min((x, i) for i, x in enumerate(row)) for row in d]
    return [i for _, i in best], [d for d, _ in best]


@pytest.mark.parametrize("top", [3, 300, 1 << 24])
@pytest.mark.parametrize("clusters", [1, 7])
def test_tree_finds_the_lowest_of_nearest(top, clusters):
    """Small numbers give many ties and equal entries; the largest leave the doubles' exact range."""
    rng = np.random.default_rng(top + clusters)
    centre = rng.integers(-top, top + 1, (clusters, 16)) // 2
    points = np.clip(centre[rng.integers(0, clusters, 256)] + rng.integers(-top // 3, top // 3 + 1, (256, 16)), -top, top)
    points[17] = points[200]
    queries = np.concatenate([points[:40], rng.integers(-top, top + 1, (60, 16))])
    index, d = op.Gnat(points).nearest(queries)
    assert (index.tolist(), d.tolist()) == tuple(map(list, plain_nearest(queries, points)))


def test_tree_rules_out_subtrees():
    rng = np.random.default_rng(1)
    centre = rng.integers(-1000, 1000, (16, 16))
    tree = op.Gnat(centre[np.arange(256) % 16] + rng.integers(-20, 20, (256, 16)))
    tree.nearest(centre[rng.integers(0, 16, 500)] + rng.integers(-20, 20, (500, 16)))
    assert tree.looked < 500 * 256 / 3


def brute(rows, entries=256):
    """[(id, code, error, label_error, sha)] of rows (id, vector, label), in Python whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [k for k in kept if len(k[1]) == size]
    w = -(-size // 4)
    cut = [[tuple((k[1] + [0] * 4)[p * w:(p + 1) * w]) for p in range(4)] for k in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            held = [[] for _ in books[p]]
            for c in cut:
                held[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(h) for x in zip(*h, strict=True)) if h else e for h, e in zip(held, books[p], strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for k, c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(4)]
        out.append((k[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), k[2], sha))
    total = Counter()
    for _, _, e, y, _ in out:
        total[y] += e
    return sorted(((i, c, e, total[y], s) for i, c, e, y, s in out), key=repr)


ODD = [(5, [0.1] * 8, 1), (None, [0.2] * 8, None), (3, [0.3, None] + [0.0] * 6, 1), (4, [float("nan")] * 8, 2), (6, [float("inf")] * 8, 2),
       (7, None, 1), (8, [], 1), (9, [0.5] * 7, 1), (5, [0.1] * 8, 1), (5, [-0.1, 0.9] * 4, None), (11, [-0.0001] * 8, 3), (12, [2.5, -7.25] * 4, 3)]
SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("sent", [op.LABELS_SENT, 1])
def test_awkward_rows(spark, monkeypatch, sent):
    """With one label sent at most, label sums go by salted copies."""
    monkeypatch.setattr(op.with_group_sums, "__defaults__", (sent,))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in ODD]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS code", "3 AS error", "4 AS q", "5 AS label_error")
    assert sorted((tuple(r) for r in op.vector_codes(df).collect()), key=repr) == brute(rows)
    assert op.vector_codes(df.limit(0)).collect() == []
    shorter = spark.createDataFrame([(i, v and [*v, 1.0], y) for i, v, y in rows], SCHEMA)        # 9 components: filled up
    assert sorted((tuple(r) for r in op.vector_codes(shorter).collect()), key=repr) == brute([(i, v and [*v, 1.0], y) for i, v, y in rows])


def test_whole_table_against_sql_and_python(spark):
    got = sorted(tuple(r) for r in op.op11_vector_codes(spark, MIDDLE).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{MIDDLE}/embeddings.parquet'")
    assert got == sorted(con.execute(op.OP11_SQL).fetchall())
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings WHERE vec_id < 40").fetchall()
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in op.vector_codes(df).collect()), key=repr) == brute(rows)


def test_components_beyond_the_limit_are_clamped(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38, 0.0, 1.0], 0), (2, [0.0] * 4, 0)], SCHEMA)
    got = {r.vec_id: (r.code, r.error) for r in op.vector_codes(df).collect()}
    assert got == {1: ("00000000", 0), 2: ("01010001", 0)}
