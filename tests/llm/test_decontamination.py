import random

import pytest

from tessera.llm import decontamination as op
from tests.llm.brute import leaks
from tests.llm.conftest import ROWS, SMALL, read


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(1)
    docs = [(r[0], r[1]) for r in read(SMALL, "documents")]
    items = [*read(SMALL, "benchmark"), (900, "short item two"), (901, ""), (902, None), (903, "one two three four five")]
    for k in range(300):
        w = rnd.choice(items[:30])[1].split()
        for _ in range(rnd.randint(0, 5)):
            j = rnd.randrange(len(w))
            w[j:j + rnd.randint(0, 1)] = rnd.choice([["zz"], [], ["yy", "xx"]])
        around = [rnd.choice(docs[:100])[1].split()[:rnd.randint(0, 40)] for _ in "ab"]
        docs.append((1000 + k, " ".join([*around[0], *w, *around[1]])))
    return docs + [(2000, "x short ITEM two y"), (2001, "one two three four"), (2002, "a one two three four five b"), (2003, None)], items


@pytest.mark.parametrize("block", [op.ITEMS, 7])
def test_matches_against_every_window(spark, tables, monkeypatch, block):
    docs, items = tables
    monkeypatch.setattr(op, "ITEMS", block)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaks(docs, items)
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in op.benchmark_matches(d, b).collect()}
    assert got == want and len(want) > 90
    assert {r.doc_id for r in op.decontaminated(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_awkward_rows_and_empty_tables(awkward, bench):
    got = {(r.doc_id, r.item_id) for r in op.benchmark_matches(awkward, bench).collect()}
    assert got == {(i, 1) for i in (1, 2, None, 10, 12)} | {(7, 5), (8, 4), (9, 4)}
    kept = op.decontaminated(awkward, bench)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, None, 6, 11]))
    assert op.benchmark_matches(awkward.limit(0), bench).count() == 0 and op.benchmark_matches(awkward, bench.limit(0)).count() == 0
    assert op.decontaminated(awkward, bench.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize(("length", "run"), [(220, 24), (300, 34)])
def test_repeated_runs(spark, length, run):
    """A run of equal words rules the fingerprint but costs little similarity."""
    rnd = random.Random(length)
    items, docs = [], []
    for k in range(6):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(length)]
        at = rnd.randrange(10, length - run - 10)
        plain, equal, other = w[at:at + run], ["row"] * run, [f"z{k}"] * run
        for i, (a, b) in enumerate([(equal, plain), (plain, equal), (equal, other), (plain, other)]):
            items.append((10 * k + i, " ".join([*w[:at], *a, *w[at + run:]])))
            docs.append((10 * k + i, " ".join(["before", *["row"] * rnd.randrange(9), *w[:at], *b, *w[at + run:], "after", "it"])))
        docs.append((10 * k + 9, " ".join([*w[:at + 4], *["row"] * 900])))
    want = leaks(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in op.benchmark_matches(d, b).collect()}
    assert got == want and sum(1 for s, _ in want.values() if s < 0.8) >= 12
