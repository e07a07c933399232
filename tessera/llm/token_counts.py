"""Operator 1: token counts from compiled finite-state transducers.

A byte-level BPE tokenizer is two machines run one after the other:

* the word splitter, a deterministic transducer over character classes.  Its transitions
  say where words begin (before this character, or one character back, which gives the
  one-character lookahead).  A text is cut into chunks; each chunk's map from every start
  state to its end state is found for all chunks at once, the maps are composed by a
  parallel prefix scan, and the chunks are then replayed from their true start states;
* the merge machine, a transducer over the bytes of a word.  A state holds, for every suffix
  of the input that is still a prefix of some vocabulary entry, the trie node, the last token
  before it and how many tokens fewer that was.  A transition finds the only token that may
  end here (it must be compatible with the token before it) and carries the number of
  emitted tokens.  The state set is finite; states are determinised when first reached.

Counts are those of the tokenizers library (tests compare them).  Null and empty texts have
no tokens; a special string inside a text is one token and ends the words around it; repeated
rows are counted each; a null ``doc_id`` is kept.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, give_back, table
from tessera.llm.words import pieces

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
WINDOW = 1 << 21          # characters that one pass of the splitter takes at most
CHUNK = 256               # characters of a chunk
MAX_WORDS = 200_000       # remembered word counts; forgotten all at once when full
MAX_STATES = 200_000      # compiled states; compiled anew when full

# Character classes of the splitter (fixed values of the pattern's contractions and classes).
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE, STMD, R, V, L, E, END = range(12)
SINGLE = "stmd"                                # 's 't 'm 'd
DOUBLE = {"r": R, "v": V, "l": L, "e": E}      # 're 've 'll
# White space of the pattern's \s besides the blank.
SPACES = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BEFORE, BACK = 1, 2                            # a word begins before this character / one back


def character_classes() -> np.ndarray:
    """Class of every code point."""
    kind = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = LETTER
        elif k == "N":
            kind[c] = NUMBER
    kind[SPACES] = SPACE
    kind[0x20] = BLANK
    kind[ord("'")] = QUOTE
    for c in SINGLE:
        kind[ord(c)] = STMD
    for c, k in DOUBLE.items():
        kind[ord(c)] = k
    return kind


STATES = ("start", "letters", "numbers", "others", "blank", "blanks", "space", "spaces", "quote", "q_r", "q_v", "q_l")


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transition and output tables (state x class) of the word splitter
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    at = {name: i for i, name in enumerate(STATES)}
    letters = {LETTER, STMD, R, V, L, E}
    run = lambda k: "letters" if k in letters else "numbers" if k == NUMBER else "others"

    def fresh(k: int) -> str:
        return {BLANK: "blank", SPACE: "space", QUOTE: "quote", END: "start"}.get(k) or run(k)

    def step(state: str, k: int) -> tuple[str, int]:
        white = k in (BLANK, SPACE)
        if state in ("blank", "blanks", "space", "spaces"):
            if white:
                return ("blanks" if k == BLANK else "spaces"), 0
            if k == END:
                return "start", BEFORE
            if state == "blank":
                return run(k), 0
            if state == "blanks":
                return run(k), BACK
            return fresh(k), BEFORE | (BACK if state == "spaces" else 0)
        if state == "letters" and k in letters or state == "numbers" and k == NUMBER:
            return state, 0
        if state in ("others", "quote") and k in (OTHER, QUOTE):
            return "others", 0
        if state == "quote" and k == STMD:
            return "start", 0
        if state == "quote" and k in (R, V, L):
            return {R: "q_r", V: "q_v", L: "q_l"}[k], 0
        if state in ("q_r", "q_v", "q_l"):
            if k == (L if state == "q_l" else E):
                return "start", 0
            if k in letters:
                return "letters", BACK
            return fresh(k), BACK | BEFORE
        return fresh(k), BEFORE

    move = np.zeros((len(STATES), END + 1), dtype=np.int16)
    says = np.zeros((len(STATES), END + 1), dtype=np.uint8)
    for name, i in at.items():
        for k in range(END + 1):
            to, says[i, k] = step(name, k)
            move[i, k] = at[to]
    return move, says


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of state maps (row i of the result: maps 0..i composed), in log2(n) rounds."""
    done, gap = maps.copy(), 1
    while gap < len(done):
        # rows gap.. : first the map that ends gap rows earlier, then their own
        done[gap:] = np.take_along_axis(done[gap:], done[:-gap].astype(np.intp), axis=1)
        gap *= 2
    return done


class Splitter:
    """Word starts of a text by chunk state maps and their prefix scan."""

    def __init__(self) -> None:
        self.kinds = character_classes()
        move, says = splitter()
        self.states, self.width = move.shape
        self.move, self.says = (move * self.width).ravel(), says.ravel()  # states stand as row offsets

    def starts(self, kinds: np.ndarray, state: int = 0) -> np.ndarray:
        """Positions at which words begin; ``kinds`` ends with END."""
        n = len(kinds)
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, END, dtype=np.int16)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        maps = np.repeat((np.arange(self.states, dtype=np.int16) * self.width)[None, :], rows, axis=0)
        for col in grid:
            maps = self.move.take(maps + col[:, None])
        first = np.empty(rows, dtype=np.int16)
        first[0] = state * self.width
        first[1:] = prefix_scan(maps // self.width)[:-1, state] * self.width
        said = np.empty((CHUNK, rows), dtype=np.uint8)
        for j, col in enumerate(grid):
            at = first + col
            said[j] = self.says.take(at)
            first = self.move.take(at)
        said = said.T.ravel()[:n]
        begins = (said & BEFORE).astype(bool)
        begins[:-1] |= (said[1:] & BACK).astype(bool)
        return np.flatnonzero(begins)


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class MergeMachine:
    """Transducer over a word's bytes that counts its tokens."""

    def __init__(self, model: dict) -> None:
        byte = byte_alphabet()
        raw = lambda s: bytes(byte[c] for c in s)
        self.rank = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[raw(a), raw(b)] = i
        self.tokens = [raw(s) for s in model["vocab"]]
        self.next: dict[int, int] = {}          # trie: node * 256 + byte -> node
        self.ends: list[int] = [-1]             # token that ends at a node
        self.inner: list[bool] = [False]
        for t, token in enumerate(self.tokens):
            node = 0
            for b in token:
                self.inner[node] = True
                nxt = self.next.get(node << 8 | b)
                if nxt is None:
                    nxt = self.next[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = nxt
            self.ends[node] = t
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone: (trie node, token before it, tokens fewer)."""
        first = ((0, -1, 0),)
        self.state = {first: 0}
        self.parts = [first]
        self.moves: dict[int, tuple[int, int]] = {}

    def merged(self, text: bytes) -> list[bytes]:
        parts = [bytes([b]) for b in text]
        while len(parts) > 1:
            best = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            a, b = parts[best[1]], parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging never crosses the border between these two tokens."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            x, y = self.tokens[a], self.tokens[b]
            known = self.fits[a, b] = self.merged(x + y) == [x, y]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from ``state`` on ``byte``: next state and emitted tokens."""
        open_, last, emitted = [], None, 0
        for node, before, fewer in self.parts[state]:
            node = self.next.get(node << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                open_.append((node, before, fewer))
            token = self.ends[node]
            if last is None and token >= 0 and (self.compatible(before, token) if before >= 0
                                                else len(self.merged(self.tokens[token])) == 1):
                last, emitted = token, 1 - fewer
        # ``fewer`` counts from the newest complete token
        parts = tuple(sorted([(n, b, f + emitted) for n, b, f in open_] + [(0, last, 0)]))
        to = self.state.get(parts)
        if to is None:
            to = self.state[parts] = len(self.parts)
            self.parts.append(parts)
        move = self.moves[state << 8 | byte] = (to, emitted)
        return move

    def count(self, word: str) -> int:
        if len(self.parts) > MAX_STATES:
            self.forget()
        state = total = 0
        moves = self.moves
        for b in word.encode("utf-8", "surrogatepass"):
            state, emitted = moves.get(state << 8 | b) or self.compile(state, b)
            total += emitted
        return total

    def counts(self, words: list[str]) -> list[int]:
        known = self.words
        out = list(map(known.get, words))
        for i, c in enumerate(out):
            if c is None:
                word = words[i]
                c = known.get(word)
                if c is None:
                    if len(known) > MAX_WORDS:
                        known.clear()
                    c = known[word] = self.count(word)
                out[i] = c
        return out


class Counter:
    """Token counts of texts with both machines."""

    def __init__(self, tokenizer: str) -> None:
        spec = json.loads(tokenizer)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without normaliser or prefix blank is compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.splitter = Splitter()
        self.machine = MergeMachine(spec["model"])

    def segments(self, text: str) -> list[str]:
        parts = [text]
        for s in self.special:
            parts = [p for part in parts for p in part.split(s)]
        return parts

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text, taken in windows of about WINDOW characters."""
        out = np.zeros(len(texts), dtype=np.int64)
        pending, owners, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            segments = self.segments(text)
            out[i] += len(segments) - 1
            # a word always begins at the cuts of ``pieces``, so they change no count
            for p in (p for s in segments for p in pieces(s, WINDOW)):
                if p:
                    pending.append(p)
                    owners.append(i)
                    size += len(p) + 1
                if size >= WINDOW:
                    self._window(pending, owners, out)
                    pending, owners, size = [], [], 0
        self._window(pending, owners, out)
        return out

    def _window(self, parts: list[str], owners: list[int], out: np.ndarray) -> None:
        if not parts:
            return
        joined = "\0".join(parts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = self.splitter.kinds.take(codes)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds[ends] = END
        starts = self.splitter.starts(kinds)
        is_end = np.zeros(len(kinds), dtype=bool)
        is_end[ends] = True
        # the END characters are boundaries of their own: the piece that begins there is no word
        stop = starts[1:]
        begin = starts[:-1]
        real = ~is_end[begin]
        begin, stop = begin[real], stop[real]
        words = [joined[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        counts = np.array(self.machine.counts(words), dtype=np.int64)
        which = np.searchsorted(ends, begin)
        per_part = np.bincount(which, weights=counts, minlength=len(parts)).astype(np.int64)
        np.add.at(out, owners, per_part)


def counter(tokenizer: str) -> Counter:
    """The Python worker's compiled counter."""
    known = give_back("token counts")
    if tokenizer not in known:
        known.clear()
        known[tokenizer] = Counter(tokenizer)
    return known[tokenizer]


def tokenizer_text(name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; ``tokenizer`` is the tokenizer's JSON."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(tokenizer)  # one vocabulary file, whatever the corpus

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = counter(shared.value)
        for batch in texts:
            yield pd.Series(machine.count(batch.tolist()))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.withColumn("n_bytes", F.octet_length(text).cast("long"))
            .withColumn("n_tokens", n_tokens(text))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_text(TOKENIZER)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
