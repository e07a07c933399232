import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import source_mixing as op
from tests.llm.conftest import MIDDLE, ROWS, read


@pytest.mark.parametrize("weights", [[1], [1, 1, 1], [5, 1, 1], [0.61, 0.2, 0.1, 0.05, 0.04], [1e-9, 1]])
def test_less_than_one_block_from_the_weights(weights):
    period = 100
    share = op.shares(np.array(weights, dtype=float), period)
    plan = op.schedule(share, period)
    assert share.sum() == period == len(plan) and (share > 0).all() and np.abs(share - np.array(weights) / sum(weights) * period).max() < 2
    assert sorted(s for _, _, s in plan) == list(range(period))
    done = [0] * len(share)
    for s, k, slot in plan:
        done[s] += 1
        assert k == done[s] - 1
        for x, a in enumerate(share):
            assert abs(Fraction(int(a) * (slot + 1), period) - done[x]) < 1


def brute(docs, block, period):
    """The slot of every document, by counting through periods."""
    rows = defaultdict(list)
    for i, s in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        rows[s or ""].append(i)
    names = sorted(rows)
    share = op.shares(np.array([len(rows[s]) ** op.TEMPER for s in names]), period)
    slots = defaultdict(dict)
    for s, k, slot in op.schedule(share, period):
        slots[s][k] = slot
    out = []
    for s, name in enumerate(names):
        for rank, i in enumerate(rows[name]):
            b = rank // block
            a = int(share[s])
            out.append((i, name, rank, b, b * period // a, -(-(b + 1) * period // a), b // a * period + slots[s][b % a]))
    return sorted(out, key=repr)


def test_every_document_gets_its_slot(spark):
    docs = [(r[0], r[3]) for r in read(MIDDLE, "documents")]
    got = op.mix_sources(spark.createDataFrame(docs, "doc_id long, source string"), block=3, period=100)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == brute(docs, 3, 100)
    assert all(release <= slot < deadline for *_, release, deadline, slot in rows)


def test_files_hold_the_mix(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    op.in_mixed_order(docs).write.parquet(f"file://{tmp_path}/mixed")
    slot = {r.doc_id: (r.mix_slot, r.mix_rank) for r in op.mix_sources(docs).collect()}
    found = spark.read.parquet(f"file://{tmp_path}/mixed").selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index n").orderBy("f", "n").collect()
    assert [slot[r.doc_id] for r in found] == sorted(slot.values())


def test_given_weights(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "doc_id long, source string")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 9.0), ("a", None), ("b", -2.0)], "source string, weight double")
    got = {r.doc_id: r.mix_slot for r in op.mix_sources(docs, weights, block=1, period=8).collect()}
    first = sorted(got, key=got.get)[:8]
    assert sum(1 for i in first if i % 2 == 0) == 6


def test_awkward_rows_and_empty_table(awkward):
    got = op.mix_sources(awkward, block=2)
    assert sorted(got.columns) == sorted({*awkward.columns, *op.MIXED})
    rows = [(r.doc_id, r.source or "", r.mix_rank, r.mix_block, r.mix_release, r.mix_deadline, r.mix_slot) for r in got.collect()]
    assert sorted(rows, key=repr) == brute([(r[0], r[3]) for r in ROWS], 2, op.PERIOD)
    assert op.in_mixed_order(awkward).count() == len(ROWS)
    assert op.mix_sources(awkward.limit(0)).count() == 0


def slot_by_slot(docs, block):
    """The exact schedule told slot by slot: of the blocks released, the one with the earliest deadline."""
    rows = defaultdict(list)
    for i, s in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        rows[s or ""].append(i)
    names = sorted(rows)
    weight = {s: Fraction(len(rows[s]) ** op.TEMPER) for s in names}
    share = {s: weight[s] / sum(weight.values()) for s in names}
    done, slot, out = dict.fromkeys(names, 0), 0, []
    while any(done[s] * block < len(rows[s]) for s in names):
        due = [(math.ceil((done[s] + 1) / share[s]), -share[s], s) for s in names
               if done[s] * block < len(rows[s]) and math.floor(done[s] / share[s]) <= slot]
        if due:
            deadline, _, s = min(due)
            k = done[s]
            for rank in range(k * block, min((k + 1) * block, len(rows[s]))):
                out.append((rows[s][rank], s, rank, k, math.floor(k / share[s]), deadline, slot))
            done[s] += 1
        slot += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, op.BLOCK])
def test_the_query_s_schedule_slot_by_slot(spark, block):
    docs = [(r[0], r[3]) for r in read(MIDDLE, "documents")]
    got = op.mix_sources(spark.createDataFrame(docs, "doc_id long, source string"), block=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slot_by_slot(docs, block)


TARGETS = [([1 / 3] + [2 / 57] * 19, [700] * 20), ([(1 / i) ** 0.5 for i in range(1, 51)], [3000 // i + 1 for i in range(1, 51)]),
           ([1e4, 1e4, 10], [5000, 5000, 7]), ([1e-5, 1, 0.3], [3, 3000, 900]), ([1], [5])]


@pytest.mark.parametrize(("weights", "blocks"), TARGETS)
def test_less_than_one_block_from_the_target_weights(weights, blocks):
    target = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    done, last = [0] * len(weights), -1
    for s, k, release, deadline, slot in op.run_plan(weights, blocks):
        assert release == k / target[s] // 1 and deadline == -(-(k + 1) / target[s] // 1) and release <= slot < deadline
        assert k == done[s] and slot > last
        done[s], last = k + 1, slot
        for x in (s, slot % len(weights)):
            assert done[x] == blocks[x] or abs(target[x] * (slot + 1) - done[x]) < 1
    assert done == blocks


def test_documents_follow_the_target_weights(spark):
    """One source of a third beside 19 alike, and a source far below a thousandth."""
    docs = spark.createDataFrame([(i, f"s{i % 20:02d}" if i % 1000 else "tiny") for i in range(20_000)], "doc_id long, source string")
    given = {"tiny": 1e-4, "s01": 10.0, **{f"s{i:02d}": 20 / 19 for i in range(20) if i != 1}}
    weights = spark.createDataFrame(list(given.items()), "source string, weight double")
    total = sum(map(Fraction, given.values()))
    rows = op.mix_sources(docs, weights, block=1).collect()
    assert len(rows) == 20_000 == len({r.mix_slot for r in rows})
    for r in rows:
        w = Fraction(given[r.source]) / total
        assert r.mix_block / w // 1 <= r.mix_slot < -(-(r.mix_block + 1) / w // 1)
