import heapq
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_output as op
from tessera.llm.queries import QUERIES
from tests.llm.conftest import ROWS, SMALL, read


def huffman_cost(counts):
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_code_is_optimal_and_decodes(n):
    rng = np.random.default_rng(n)
    counts = (1e6 / np.arange(1, n + 1) ** 1.2).astype(int) + 1
    rng.shuffle(counts)
    loose, tight = op.code_lengths(counts, 40), op.code_lengths(counts, max(1, int(np.ceil(np.log2(n)))))
    if n > 1:
        assert (loose * counts).sum() == huffman_cost(counts.tolist())
        assert tight.max() <= np.ceil(np.log2(n)) and (2.0 ** -tight[tight > 0].astype(float)).sum() <= 1
    for lengths in (op.code_lengths(counts, 18), tight):
        code = op.Code(lengths)
        for size in (1, op.CHECKPOINT, 3 * op.CHECKPOINT + 5):
            ids = rng.choice(n, size).astype("<u4")
            assert (code.decode(*code.encode(ids), size) == ids).all()


def test_limited_code_against_all_codes():
    """Package-merge against every assignment of lengths that is a prefix code, on a small alphabet."""
    counts, limit = np.array([1, 1, 2, 7, 30]), 3
    best = min(sum(c * x for c, x in zip(counts, ls, strict=True)) for ls in np.ndindex(*[limit] * 5)
               for ls in [tuple(x + 1 for x in ls)] if sum(2.0 ** -x for x in ls) <= 1)
    assert (op.code_lengths(counts, limit) * counts).sum() == best


def library(texts):
    t = Tokenizer.from_str(op.tokenizer_text(op.TOKENIZER))
    return [[*t.encode(x or "", add_special_tokens=False).ids, op.END_ID] for x in texts]


def test_words_have_the_ids_of_the_whole_text(monkeypatch):
    rnd = random.Random(3)
    texts = ["\u03a3\u0391\u03a3 \u039f\u0394\u039f\u03a3 \u03a3", "e\u0301 \u0301 \u0301a", "a\u00a0b\x1cc\x85d\u2003e", "<|endoftext|> x<|endoftext|>y",
             "<|ENDOFTEXT|> X", "J\u030c \u01f0 K.", "don't 's 'S it's. X., y,. z..", "a. A. . , \u00e9. 9.", ""]
    texts += ["".join(rnd.choice("a\u03a3\u00e9\u0301 '<|end>\n\t\x0b\x0c\x85\u3000\u21639\u65e5\u0130.,AJ\u030c") for _ in range(50)) for _ in range(3000)]
    texts.append("".join(chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000))
    want = library(texts)
    for words, piece in ((op.MAX_WORDS, op.PIECE), (100, 30)):
        monkeypatch.setattr(op, "MAX_WORDS", words)
        monkeypatch.setattr(op, "PIECE", piece)
        enc = op.WordEncoder(op.tokenizer_text(op.TOKENIZER), "<u2")
        assert enc.by_word and [[*np.frombuffer(enc.encode(t), "<u2").tolist(), op.END_ID] for t in texts] == want


def test_other_tokenizers_get_whole_texts():
    spec = op.tokenizer_text("byte_bpe_50k.json")
    texts = ["The  quick brown fox.", "", "don't"]
    want = [Tokenizer.from_str(spec).encode(t).ids for t in texts]
    enc = op.WordEncoder(spec, op.id_width(spec))
    assert not enc.by_word and [np.frombuffer(enc.encode(t), "<u2").tolist() for t in texts] == want


def test_query_reads_back_what_was_written(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_IDS", 3000)
    docs, start, want = read(SMALL, "documents"), 0, {}
    for r, ids in zip(docs, library([r[1] for r in docs]), strict=True):
        want[r[0]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_output"](spark, SMALL).collect()} == want


def test_awkward_rows_and_empty_table(spark, awkward, tmp_path):
    spec = op.tokenizer_text(op.TOKENIZER)
    op.write_token_files(awkward, spec, f"file://{tmp_path}/a", ["doc_id"])
    got = op.read_ids(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert sorted((r.doc or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted(
        (r[0] or -1, ids) for r, ids in zip(ROWS, library([r[1] for r in ROWS]), strict=True))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert [r.doc or -1 for r in got] == sorted(r.doc or -1 for r in got)
    op.write_token_files(awkward.limit(0), spec, f"file://{tmp_path}/b", ["doc_id"])
    assert op.read_ids(spark, f"file://{tmp_path}/b").count() == 0


def test_words_with_marks_take_the_ids_of_learnt_words():
    import numpy as np

    from tessera.llm import token_output as t
    from tessera.llm.token_counts import tokenizer_text
    e = t.WordEncoder(tokenizer_text(t.TOKENIZER), "<u4")
    asked, merge = [], e.merge
    e.merge = lambda word: asked.append(word) or merge(word)
    texts = ["bohrung bohrung, (bohrung bohrung!? bohrung", "it's rock'n'roll... don't", "x~ y| <unk> ab<unk> z_z a-b, été; 12, ,", "!!! ?! a."]
    for text in texts:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert asked.count("bohrung") == 1
