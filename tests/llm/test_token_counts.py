import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_counts as op
from tessera.llm.queries import QUERIES
from tessera.llm.words import pieces
from tests.llm.conftest import ROWS, SMALL, read

ODD = ["don't you've we'll I'm he'd 's 're''s 'r 'v 'l 'x  'S", "a  b   c\n\n d\t\te \n", "   ", "\n", "x\n\n", "", None,
       "<|endoftext|>a <|endoftext|>b c<|endoftext|>", "\0a\0\0b", "a" * 700, "0123456789" * 30, "!?" * 100 + "\x1c\x1d a",
       "'l l 'll'l", " 'll  'll", "a\u00a0b\u2003\u2003c\u3000\u3000\u200b", "\u0661\u0662 x\u00b2\u00bd \U0001F600"]


@pytest.fixture(scope="module")
def machine():
    return op.Counter(op.tokenizer_text(op.TOKENIZER))


def library(texts):
    t = Tokenizer.from_str(op.tokenizer_text(op.TOKENIZER))
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts_equal_the_library(machine):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("ab 'sdtrelv\n\t12!\u00e9\u65e5  ") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    assert machine.count(texts).tolist() == library(texts)


def test_every_character_class(machine):
    chars = "".join(chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000)
    texts = ["a".join(chars[i:i + 50]) for i in range(0, len(chars), 50)]
    assert machine.count(texts).tolist() == library(texts)


def test_scan_composes_state_maps():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 5, (37, 5))
    state, want = np.arange(5), []
    for m in maps:
        state = m[state]
        want.append(state)
    assert (op.prefix_scan(maps) == np.array(want)).all()


def test_windows_and_full_caches_change_nothing(machine, monkeypatch):
    texts = [t for _, t in [(r[0], r[1]) for r in read(SMALL, "documents")]]
    want = library(texts)
    monkeypatch.setattr(op, "WINDOW", 500)
    monkeypatch.setattr(op, "MAX_WORDS", 50)
    monkeypatch.setattr(op, "MAX_STATES", 500)
    assert machine.count(texts).tolist() == want


def test_pieces_join_to_the_text():
    text = "ab  c\n\nd " * 100
    assert "".join(pieces(text, 40)) == text and len(pieces(text, 40)) > 10 and pieces("x" * 100, 40) == ["x" * 100]


def test_query_and_awkward_rows(spark, awkward):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op1_token_counts"](spark, SMALL).collect()}
    docs = read(SMALL, "documents")
    want = library([r[1] for r in docs])
    assert got == {r[0]: (len((r[1] or "").encode()), n, n > 1024) for r, n in zip(docs, want, strict=True)}
    counted = op.token_counts(awkward, op.tokenizer_text(op.TOKENIZER))
    assert counted.columns.count("n_tokens") == 1
    rows = counted.select("doc_id", "n_tokens").collect()
    assert sorted(map(repr, rows)) == sorted(f"Row(doc_id={r[0]}, n_tokens={n})" for r, n in zip(ROWS, library([r[1] for r in ROWS]), strict=True))
    assert op.token_counts(awkward.limit(0), op.tokenizer_text(op.TOKENIZER)).count() == 0
