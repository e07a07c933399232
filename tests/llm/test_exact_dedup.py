import hashlib
import re
from collections import defaultdict

import pytest

from tessera.llm import exact_dedup as op
from tests.llm.conftest import MIDDLE, ROWS, read


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("capacity", [op.CAPACITY, 40, 1])
def test_groups_at_any_bucket_size(spark, capacity):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = op.exact_dedup(docs, capacity=capacity)
    rows = got.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == brute([(r[0], r[1]) for r in read(MIDDLE, "documents")])
    held = defaultdict(set)
    for r in rows:
        held[r.bucket].add(r.text_sha256)
    assert max(map(len, held.values())) <= max(capacity, 4)


def test_collisions_are_chained(spark, monkeypatch):
    """With one key for all texts, bytes alone tell groups apart."""
    monkeypatch.setattr(op.F, "xxhash64", lambda *c: op.F.lit(7).cast("long") + op.F.length(c[0]) * 0)
    rows = [(i, f"text {i % 5}") for i in range(40)]
    got = op.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), capacity=2).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(rows) and {r.chain for r in got} == set(range(5))


def test_hot_texts_are_combined_before_their_owner(spark, monkeypatch):
    """A text with half of all rows, at any bound of hot keys; owners receive it from few combined rows."""
    rows = [(i, "hot  text" if i % 2 else f"cold {i // 6}") for i in range(3000)] + [(None, "hot\ttext"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    moved, real = [], op.owned_entries
    monkeypatch.setattr(op, "owned_entries", lambda t, *a: moved.append(t.filter("norm = 'hot text'").count()) or real(t, *a))
    for hot in (100, 10_000, op.HOT_BYTES):
        got = op.exact_dedup(docs, capacity=100, hot_bytes=hot).collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(rows)
    assert moved == [1, 1, 1501]


def test_groups_come_from_their_owners(spark):
    """Owners hold whole buckets, and one shuffle by bucket serves grouping and chaining."""
    texts = spark.createDataFrame([(k << 60, f"t{k % 3}{i % 2}", i, 1) for k in range(-8, 8) for i in range(6)],
                                  "key long, norm string, keep_id long, group_size long")
    cells, depth = op.directory(texts.select("key").distinct(), 4)
    got = op.owned_entries(texts, cells, depth)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == plan.count("Exchange hashpartitioning(") == 1
    rows = got.withColumn("task", op.F.spark_partition_id()).collect()
    assert {(r.keep_id, r.group_size, r.chain) for r in rows} == {(0, 3, 0), (1, 3, 1)} and len(rows) == 32
    owners = defaultdict(set)
    for r in rows:
        owners[r.bucket].add(r.task)
    assert depth == 2 and len(owners) == 4 and all(len(t) == 1 for t in owners.values())


def test_awkward_rows_and_empty_table(awkward):
    got = [tuple(r)[:5] for r in op.exact_dedup(awkward).collect()]
    assert sorted(got, key=repr) == brute([(r[0], r[1]) for r in ROWS])
    assert op.exact_dedup(awkward.limit(0)).count() == 0
