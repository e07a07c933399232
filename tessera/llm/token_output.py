"""Operator 3: token ids in Huffman-coded binary blocks.

Ids of all documents are counted over the whole corpus; one canonical, length-limited code
(package-merge) is made from these counts, of which there are at most as many as the vocabulary
has entries.  Documents are dealt out by ranges of their order, and each task writes independent
blocks of whole documents:

    shard      number of the range, ascending in the order
    block      number of the block within the shard
    start      ids of the shard before this block
    doc        the documents' keys, in order
    length     ids of each document, the end id included
    payload    the code words of all ids, most significant bit first
    offsets    bit offset of every CHECKPOINT-th id

A block is decoded without any other, and within a block all stretches between checkpoints are
decoded at once by one table of 2**longest entries.  The code lengths are a table beside the
blocks; canonical codes follow from them.

Null and empty texts have only the end id.  Documents with equal keys are all written, in the
order of their ids' bytes; null keys come first.  Extra columns are ignored; an empty table
gives no blocks.  Very long texts make a block of their own.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, give_back, table
from tessera.llm.token_counts import byte_alphabet, tokenizer_text
from tessera.llm.words import pieces
from tessera.session import materialize, scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 1 << 18        # a block closes with the document that reaches so many ids
CHECKPOINT = 256           # ids between two bit offsets
PIECE = 1 << 20            # characters that are split into words at once
MAX_WORDS = 300_000        # remembered words of a task, and as many that were in use before them
LONGEST = 18               # bits of a code word; one more than needed for larger vocabularies


# -- encoding texts -----------------------------------------------------------------------

class Words(dict):
    """Ids (bytes) by word (bytes); unknown words are looked up among those in use before, else learnt."""

    def __init__(self, learn, old: dict) -> None:
        super().__init__()
        self.learn, self.old = learn, old

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.learn(word)
        self[word] = ids
        return ids


class WordEncoder:
    """Ids of texts by the tokenizers library, which sees every distinct word once.

    A tokenizer that drops white space has no rule that looks across it, so a text's ids are its
    words' ids one after the other.  If it also lower-cases, ASCII letters are lower-cased first,
    except where this could make a special string or compose with a combining mark.  A word of
    lower-case Latin letters is one piece of the tokenizer and goes to the library's merge model
    directly, and marks that follow it are a piece of their own.  All other words go through the
    whole tokenizer.  Tokenizers of other kinds get whole texts.
    """

    def __init__(self, tokenizer: str, width: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer)
        self.tokenizer, self.width = Tokenizer.from_str(tokenizer), width
        self.merge = self.tokenizer.model.tokenize
        split = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.by_word = (spec["model"].get("end_of_word_suffix") is not None and len(split) == 1 and split[0]["behavior"] == "Removed"
                        and split[0]["invert"] and split[0]["pattern"].get("Regex") == WORD_PATTERN)
        self.lower = self.by_word and any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        self.special = [t["content"].encode().lower() for t in spec["added_tokens"]]
        size = np.dtype(width).itemsize
        raw = np.arange(self.tokenizer.get_vocab_size(), dtype=width).tobytes()
        self.raw = [raw[i: i + size] for i in range(0, len(raw), size)]         # bytes of each id
        self.known = Words(self._learn, {})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def _learn(self, word: bytes) -> bytes:
        raw, stem = self.raw, word.rstrip(MARKS)
        if self.lower and stem.isalpha() and stem.islower():                     # ASCII letters stand for themselves
            if len(stem) < len(word):                                            # most stems are words that have been learnt
                return self.known[stem] + self.known[word[len(stem):]]
            return b"".join([raw[t.id] for t in self.merge(word.decode())])
        text = word.decode("utf-8", "surrogatepass")
        plain = LATIN.match(text) if self.lower else None
        if not plain or plain[1] != plain[1].lower():
            return self._whole(text)
        stem, tail = plain.groups()
        ids = b"".join([raw[t.id] for t in self.merge(stem.encode().decode("latin-1").translate(BYTE_CHARS))])
        return ids + self.known[tail.encode()] if tail else ids

    def _split(self, text: str) -> list[bytes]:
        data = text.encode("utf-8", "surrogatepass")
        if self.lower:
            low = data.lower()
            if b"\xcc" not in data and b"\xcd" not in data and not any(s in low for s in self.special):
                data = low
        return data.split()

    def encode(self, text: str) -> bytes:
        """Ids of a text in ``width``, end to end."""
        if not self.by_word:
            return self._whole(text)
        out = []
        for part in pieces(text, PIECE):
            if len(self.known) > MAX_WORDS:
                self.known.old = {}
                self.known = Words(self._learn, self.known)
            out.append(b"".join(map(self.known.__getitem__, self._split(part))))
        return b"".join(out)


# the pattern of words that the tokenizer keeps (a fixed value); nothing of it holds white space
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Latin letters, of which lower-case ones stay as they are, then ASCII marks without the apostrophe
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
LATIN = re.compile("([a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)\\Z")
BYTE_CHARS = {b: c for c, b in byte_alphabet().items()}


def encoder(tokenizer: str, width: str) -> WordEncoder:
    """The Python worker's encoder with the words it has learnt."""
    known = give_back("token ids")
    if (tokenizer, width) not in known:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core
        known.clear()
        known[tokenizer, width] = WordEncoder(tokenizer, width)
    return known[tokenizer, width]


def id_width(tokenizer: str) -> str:
    """Unsigned integers that hold every id of the vocabulary."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_str(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, tokenizer: str, order: list[str], width: str, text_col: str = "text",
                     end_id: int = END_ID) -> DataFrame:
    """(order columns, ids): ids as little-endian integers of ``width``, the end id last."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(tokenizer)  # one vocabulary file, whatever the corpus

    @F.pandas_udf("binary")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(shared.value, width)
        end = np.array([end_id], dtype=width).tobytes()
        for batch in texts:
            yield pd.Series([enc.encode(text) + end for text in batch])

    return docs.select(*order, ids(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


# -- the code -----------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Code word lengths of an optimal prefix code with at most ``longest`` bits (package-merge).

    Symbols without counts get length 0; a single symbol gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << longest:
        raise ValueError("more symbols than code words of that length")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64)
    n = len(coins)
    # level by level: the sorted coins merged with the packages of the level below
    weight, levels = coins, []
    for _ in range(longest - 1):
        even = len(weight) // 2 * 2
        package = weight[0:even:2] + weight[1:even:2]
        both = np.concatenate([coins, package])
        order = np.argsort(both, kind="stable")
        levels.append(order < n)
        weight = both[order]
    take, total = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_coin in reversed(levels):
        single = int(is_coin[:take].sum())      # the cheapest coins of this level
        total[:single] += 1
        take = 2 * (take - single)              # its packages stand for pairs one level below
    total[:take] += 1
    lengths[used] = total
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code words, and symbols in canonical order (by length, then symbol)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    longest = int(lengths.max(initial=1))
    # as left-aligned numbers, each code word begins where the one before it ends
    size = np.left_shift(1, longest - lengths[order].astype(np.int64))
    at = np.cumsum(size) - size
    codes = np.zeros(len(lengths), dtype=np.uint32)
    codes[order] = at >> (longest - lengths[order].astype(np.int64))
    return codes, order


class Code:
    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        self.codes, order = canonical(lengths)
        self.longest = int(lengths.max(initial=1))
        self.left = self.codes.astype(np.uint64) << np.minimum(64 - self.lengths, 63).astype(np.uint64)    # a symbol without a code word has code 0
        self.table = np.repeat(order, np.left_shift(1, self.longest - self.lengths[order])).astype(np.uint32)
        self.table = np.pad(self.table, (0, (1 << self.longest) - len(self.table)))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream of ``ids`` and the bit offset of every CHECKPOINT-th of them."""
        size = self.lengths.take(ids)
        ends = np.cumsum(size)
        at = ends - size
        words = np.zeros((int(ends[-1]) >> 5) + 2, dtype=np.uint64)
        # two 32-bit words hold each code word: left-aligned in 64 bits, joined with those of the same word, then cut in halves
        code = self.left.take(ids) >> (at & 31).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        code, word = np.bitwise_or.reduceat(code, first), word[first]
        words[word] |= code >> np.uint64(32)
        words[word + 1] |= code & np.uint64(0xFFFFFFFF)
        stream = words.astype(">u4").tobytes()
        return stream[: (int(ends[-1]) + 7) >> 3], at[::CHECKPOINT]

    def decode(self, stream: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """All ids of a block: the stretches between checkpoints in step with one another."""
        data = np.frombuffer(stream + b"\0" * 8, dtype=np.uint8)
        width = (self.longest + 14) // 8                  # bytes that hold a code word wherever it begins
        last = len(data) - 8
        seen = np.zeros(last + 1, dtype=np.uint32 if width <= 4 else np.int64)      # those from each byte on
        for j in range(width):
            seen <<= 8
            seen |= data[j: last + 1 + j]
        out = np.empty((CHECKPOINT, len(offsets)), dtype=np.uint32)
        at, mask, spare = offsets.astype(np.int64), (1 << self.longest) - 1, 8 * width - self.longest
        both = self.table << np.uint32(6) | self.lengths.astype(np.uint32).take(self.table)     # symbol and length: fewer than 2**26 symbols
        for k in range(CHECKPOINT):
            word = seen.take(np.minimum(at >> 3, last)) >> (spare - (at & 7)) & mask
            out[k] = both.take(word)
            at += out[k] & 63
        out >>= 6
        return out.T.ravel()[:n]


# -- files ----------------------------------------------------------------------------------

BLOCK_SCHEMA = "shard int, block int, start long, doc array<{key}>, length array<long>, payload binary, offsets array<long>"


def count_ids(encoded: DataFrame, width: str) -> DataFrame:
    """(id, n) over all documents: counted in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=width)
            c = np.bincount(ids, minlength=len(total))
            c[: len(total)] += total
            total = c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    return encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def corpus_code(encoded: DataFrame, width: str) -> np.ndarray:
    """Code lengths by id.  The vocabulary bounds what reaches the driver."""
    counts = count_ids(encoded, width).toPandas()
    if counts.empty:
        return np.zeros(1, dtype=np.uint8)
    by_id = np.zeros(int(counts["id"].max()) + 1, dtype=np.int64)
    by_id[counts["id"].to_numpy()] = counts["n"].to_numpy()
    return code_lengths(by_id, max(LONGEST, int(np.count_nonzero(by_id) - 1).bit_length() + 1))


def write_blocks(encoded: DataFrame, lengths: np.ndarray, order: list[str], key: str, path: str, width: str,
                 shards: int | None = None) -> None:
    """Write ``encoded`` (order columns, ids) in ascending order as blocks and code lengths."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(lengths)  # one byte for each entry of the vocabulary
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(encoded.inputFiles()))
    kind = encoded.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        shard, code = TaskContext.get().partitionId(), Code(shared.value)
        docs, parts, held, start, block = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            stream, offsets = code.encode(ids)
            one = lambda values, t: pa.array([values], pa.list_(t))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                 one(docs, docs_type), one([len(p) for p in parts], pa.int64()), pa.array([stream], pa.binary()),
                 one(offsets, pa.int64())],
                names=["shard", "block", "start", "doc", "length", "payload", "offsets"])

        for b in batches:
            docs_type = b.column(0).type
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(doc)
                parts.append(np.frombuffer(ids, dtype=width))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield close()
                    docs, parts, start, held, block = [], [], start + held, 0, block + 1
        if docs:
            yield close()

    ranges = [F.col(c).asc_nulls_first() for c in order]
    blocks = (encoded.repartitionByRange(shards, *ranges).sortWithinPartitions(*ranges, "ids")
              .select(key, "ids").mapInArrow(encode, BLOCK_SCHEMA.format(key=kind)))
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytes(lengths),)], "lengths binary").write.mode("overwrite").parquet(f"{path}/code")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode the files: (shard, doc, start, n_tokens, ids_crc32, ids), ``start`` over all shards.

    ``ids`` are little-endian unsigned 32-bit integers; without them only the digests leave a task."""
    arrow_limits(spark)
    lengths = spark.read.parquet(f"{path}/code").first()["lengths"]
    shared = spark.sparkContext.broadcast(np.frombuffer(lengths, dtype=np.uint8))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        code = Code(shared.value)
        for b in batches:
            for row in range(b.num_rows):
                col = lambda name, row=row, b=b: b.column(b.schema.get_field_index(name))[row]
                length = np.asarray(col("length").values)
                ids = code.decode(col("payload").as_py(), np.asarray(col("offsets").values), int(length.sum())).astype("<u4", copy=False)
                cuts = np.cumsum(length)
                flat = memoryview(ids).cast("B")
                raw = [flat[4 * (b - n): 4 * b] for b, n in zip(cuts.tolist(), length.tolist(), strict=True)]
                out = [pa.array([col("shard").as_py()] * len(length), pa.int32()), col("doc").values,
                       pa.array(cuts - length + col("start").as_py()), pa.array(length), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(raw, pa.binary())] * with_ids,
                                                 names=["shard", "doc", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    rows = blocks.mapInArrow(decode, f"shard int, doc {kind}, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    # one row for each shard: as many as the writer had tasks
    total = (blocks.select("shard", F.expr("aggregate(length, 0L, (a, x) -> a + x)").alias("n"))
             .groupBy("shard").agg(F.sum("n").alias("n")))
    before = total.withColumn("before", F.coalesce(F.sum("n").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(before.select("shard", "before")), "shard").withColumn("start", F.col("at") + F.col("before"))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, order: list[str], key: str = "doc_id",
                      text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode ``docs`` and write them to ``path`` in ascending ``order``."""
    spark = docs.sparkSession
    # the ids are read twice (counts, code words): kept as a table, with two bytes where they fit
    width = id_width(tokenizer)
    encoded = encode_documents(docs, tokenizer, list(dict.fromkeys([*order, key])), width, text_col, end_id)
    raw = scratch_path(spark, "token-ids")
    encoded.write.option("compression", "zstd").parquet(raw)
    encoded = spark.read.parquet(raw)
    write_blocks(encoded, corpus_code(encoded, width), order, key, path, width)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "token-files")
    write_token_files(docs, tokenizer_text(TOKENIZER), path, ["doc_id"])
    return read_ids(spark, path, with_ids=False).select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")
