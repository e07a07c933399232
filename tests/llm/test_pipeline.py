"""The pipeline against a plain version, stage by stage, and each stage on awkward tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import quality, source_mixing
from tessera.llm.token_output import END_ID, TOKENIZER, tokenizer_text
from tests.llm.brute import leaks, near_components
from tests.llm.conftest import MIDDLE, read


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    columns, made = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{len(made)}"
        stage(spark, docs, MIDDLE).write.parquet(path)
        docs = spark.read.parquet(path)
        made.append((name, docs))
        assert docs.columns == columns or len(made) == 5
    texts = {r[0]: (r[1], r[3]) for r in read(MIDDLE, "documents")}
    kept = [{r.doc_id for r in d.select("doc_id").collect()} for _, d in made]
    # 1: what the fitted model rejects goes, and it is right about held-out documents' labels elsewhere
    model = quality.fit_model(spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet"))
    scores = model.scores(pa.array([t for t, _ in texts.values()]))
    assert kept[0] == {i for i, s in zip(texts, scores, strict=True) if s >= quality.THRESHOLD}
    good = {r[0]: r[1] for r in read(MIDDLE, "labels")}
    assert np.mean([(i in kept[0]) == good[i] for i in good]) > 0.97
    # 2: the smallest id of each component
    root = near_components([(i, texts[i][0]) for i in sorted(kept[0])])
    assert kept[1] == {i for i, (_, r) in root.items() if r == i}
    # 3: no benchmark item is left
    found = leaks([(i, texts[i][0]) for i in kept[1]], read(MIDDLE, "benchmark"))
    assert found and kept[2] == kept[1] - {i for i, _ in found}
    # 4: all documents, in the order of their slots
    assert kept[3] == kept[2]
    slot = {r.doc_id: (r.mix_slot, r.mix_rank) for r in source_mixing.mix_sources(made[2][1]).collect()}
    # 5: their ids one after the other in that order
    t = Tokenizer.from_str(tokenizer_text(TOKENIZER))
    start, want = 0, []
    for i in sorted(slot, key=slot.get):
        ids = np.array([*t.encode(texts[i][0], add_special_tokens=False).ids, END_ID], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in made[4][1].collect()) == sorted(want)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, MIDDLE).collect()) == sorted(want)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_tables(spark, awkward, labels, bench, tmp_path, empty):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward.limit(0) if empty else awkward, str(tmp_path))
        assert (out.count() == 0) if empty else out.count() > 0
        assert stage is corpus_pipeline.token_output or set(out.columns) == set(awkward.columns)
