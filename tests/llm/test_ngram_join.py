import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ngram_join as op
from tessera.llm.signature_tree import Joined, SignatureTree, bitmap_width, class_borders, spanning_links
from tessera.llm.words import shingles_of, words_of
from tests.llm.brute import near_components, shingles, words
from tests.llm.conftest import ROWS, SMALL, read


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"zz{rnd.randint(0, 99)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def docs():
    """The small table, a large group of near copies, and a passage that many documents share."""
    rnd = random.Random(4)
    out = [(r[0], r[1]) for r in read(SMALL, "documents")]
    base = " ".join(f"w{rnd.randint(0, 10 ** 6)}" for _ in range(150))
    out += [(1000 + i, edited(rnd, base, rnd.randint(0, 6))) for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    out += [(2000 + i, passage + " " + " ".join(f"u{rnd.randint(0, 10 ** 6)}" for _ in range(rnd.randint(10, 90)))) for i in range(100)]
    return out


@pytest.mark.parametrize(("part_tokens", "common"), [(op.PART_TOKENS, op.COMMON), (800, 3)])
def test_components_against_all_pairs(spark, docs, monkeypatch, part_tokens, common):
    monkeypatch.setattr(op, "COMMON", common)
    monkeypatch.setattr(op, "RANGE_BYTES", 1 << 16)
    got = op.ngram_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), part_tokens=part_tokens)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == near_components(docs)


def test_tree_finds_every_component():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 40, 80).astype(np.uint64) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(12):
            drop = rng.integers(0, 40)
            sets.append(np.unique(np.concatenate([b[drop // 2:], rng.integers(0, 1 << 40, drop).astype(np.uint64)])))
    sets = [sets[i] for i in rng.permutation(len(sets))]
    tree = SignatureTree(sets, np.array([len(s) for s in sets]))
    links = tree.links()
    root = list(range(len(sets)))
    for a, b in ((a, b) for a in range(len(sets)) for b in range(a)):
        inter = len(np.intersect1d(sets[a], sets[b]))
        if 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    assert [tree.find(i) for i in range(len(sets))] == root and len(links) == len(sets) - len(set(root))


def random_sets(rng, groups, least, most):
    """Groups of sets that differ a little, of many sizes."""
    sets = []
    for _ in range(groups):
        base = np.unique(rng.integers(0, 1 << 40, int(rng.integers(least, most))).astype(np.uint64))
        for _ in range(int(rng.integers(1, 9))):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([keep if len(keep) else base, rng.integers(0, 1 << 40, int(rng.integers(0, 1 + len(base) // 8))).astype(np.uint64)])))
    return [sets[i] for i in rng.permutation(len(sets))]


def roots_by_all_pairs(sets):
    held = [frozenset(s.tolist()) for s in sets]
    joined = Joined(len(sets))
    for a, x in enumerate(held):
        for b, y in enumerate(held[:a]):
            inter = len(x & y)
            if 100 * inter >= 75 * (len(x) + len(y) - inter):
                joined.union(a, b)
    return [joined.find(i) for i in range(len(sets))]


@pytest.mark.parametrize("bitmap_bytes", [0, 2000, 20_000, 1 << 25])
def test_trees_by_size_class_find_every_component(bitmap_bytes):
    rng = np.random.default_rng(8)
    for least, most in ((1, 12), (5, 400)):
        sets = random_sets(rng, 25, least, most)
        want = roots_by_all_pairs(sets)
        links = spanning_links(sets, np.array([len(s) for s in sets]), [None] * len(sets), bitmap_bytes)
        # each link joins two components and none is missing
        assert all(want[a] == want[b] for a, b in links) and len(links) == len(sets) - len(set(want))
        again = spanning_links(sets, np.array([len(s) for s in sets]), want, bitmap_bytes)
        assert again == []


def test_sets_link_with_the_next_size_class_at_most():
    borders = class_borders(3000)
    at = np.searchsorted(borders, np.arange(3001), "right")
    for n in range(1, 2251):
        assert at[4 * n // 3] - at[n] <= 1
    assert (np.diff(borders) > 0).all() and borders[-1] > 3000 >= borders[-2]


def test_one_long_set_does_not_widen_the_bitmaps_of_the_others():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 40, 5).astype(np.uint64)) for _ in range(20_000)]
    sets.append(np.unique(rng.integers(0, 1 << 40, 40_000).astype(np.uint64)))
    assert 20_000 * bitmap_width(40_000) >> 3 > 150 << 20
    # only memory counts here, so all short sets are one component already
    tracemalloc.start()
    assert spanning_links(sets, np.array([len(s) for s in sets]), [0] * 20_000 + [None]) == []
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_parts_of_a_block_meet_by_size(spark):
    """One block of some 50 parts: far fewer rows than all pairs of parts go out, and no link is lost."""
    rng = np.random.default_rng(10)
    sets = random_sets(rng, 120, 4, 300)
    rows = [("x", f"k{i:04d}", len(s), s.tobytes()) for i, s in enumerate(sets)]
    blocks = spark.createDataFrame(rows, "block string, k string, n long, tokens binary")
    size = sum(len(s) + op.SET_TOKENS for s in sets) // 50
    cuts = op.part_cuts(blocks, size)
    now = op.parted(blocks, cuts, size, "inner").withColumn("label", op.F.col("k"))
    at = {r.k: r.part for r in now.collect()}
    parts = len(set(at.values()))
    assert len(at) == len(rows) and 40 <= parts <= 51
    weight = [sum(len(s) + op.SET_TOKENS for (_, k, _, _), s in zip(rows, sets, strict=True) if at[k] == p) for p in set(at.values())]
    assert max(weight) < 3 * size
    sent = sum(now.join(op.part_pairs(now, near), ["block", "part"]).filter("n >= least AND n <= most").count() for near in (True, False))
    assert sent < 0.4 * (parts - 1) * len(rows)
    want = roots_by_all_pairs(sets)
    found = [(int(r.a[1:]), int(r.b[1:])) for r in op.find_links(blocks, size).collect()]
    root = Joined(len(sets))
    for a, b in found:
        assert want[a] == want[b]
        root.union(a, b)
    assert [root.find(i) for i in range(len(sets))] == want


def test_hashes_are_those_of_words_and_shingles():
    texts = [r[1] for r in ROWS] + ["A b\x0bC  d e F", "a B c d e f"]
    got, cuts = shingles_of(*words_of(pa.array(texts)))
    known = {}
    for i, t in enumerate(texts):
        want = shingles(words(t))
        assert len(want) == cuts[i + 1] - cuts[i]
        for s, h in zip(want, got[cuts[i]:cuts[i + 1]].tolist(), strict=True):
            assert known.setdefault(s, h) == h
    assert len(set(known.values())) == len(known)


def test_awkward_rows_and_empty_table(awkward):
    got = sorted(map(repr, op.ngram_components(awkward).select("doc_id", "n_shingles", "component_id").collect()))
    size = {r[1]: len(set(shingles(words(r[1])))) for r in ROWS}
    root = lambda i, t: (1 if "quick" in t else 8 if t.lower().startswith("two") else i) if words(t) else i
    assert got == sorted(f"Row(doc_id={r[0]}, n_shingles={size[r[1]]}, component_id={root(r[0], r[1] or '')})" for r in ROWS)
    assert op.ngram_components(awkward.limit(0)).count() == 0
    kept = op.one_of_each_group(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # the texts of 1, 2, 10, 12 and of a row without id are one group; the other text of 1 is a group of its own
    assert ids == sorted(map(str, [1, 1, 3, 4, 5, 6, 7, 8, 11, None]))
    assert op.one_of_each_group(awkward.limit(0)).count() == 0


def test_rows_without_words_stay_beside_repeated_rows(spark):
    empty = [(1, ""), (1, ""), (2, None), (2, None), (None, " \t"), (None, " \t")]
    for rows in (empty, [*empty, (3, "some words"), (3, "some words")]):
        kept = op.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, [*empty, *rows[6:7]]))
