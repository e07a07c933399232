"""Operator 9: documents that hold a benchmark item.

For an item of m words every window of m words of a document is considered (a shorter
document is one window).  Texts are multisets of 5-word shingles; an item with fewer words is
one shingle of all of them.

* Windows that share no shingle with an item have similarity 0, so only windows around shared
  shingles get a fingerprint.
* A fingerprint is a SimHash of 256 bits over the window's shingles, each weighted by how often
  it occurs.  Items of one size are indexed by blocks: a fingerprint within ``RADIUS`` bits
  differs by at most ``RADIUS // BLOCKS`` bits in one of the blocks at least, and the index has
  for every block value the items that near.  So no item within the radius is missed.
* Candidates within the radius are compared exactly: weighted Jaccard similarity of the two
  multisets of shingles, sum of minima over sum of maxima, at least 0.75.
* Where shingles repeat, in the item or within a window's length in the document, the repeated
  one rules most bits and the radius says nothing.  Such pairs do not go by fingerprints: the sum
  of minima is counted for every window that shares a shingle with the item (``_sweep``).

Where all shingles count once, two windows at similarity 0.75 differ in 44 of 256 bits on average
(standard deviation 6); the radius leaves more than four and a half standard deviations.

The benchmark goes to the tasks in blocks of bounded size, one after the other; documents are
read where they are, with no shuffle.  Null texts and texts without words hold nothing and are
held by nothing.  Items with equal texts each match.  Rows that repeat a doc_id give its best
match once.  Extra columns are ignored by the search and kept by the filter; empty tables give
no matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, give_back, table
from tessera.llm.words import SHINGLE, mix, odd_numbers, shingles_of, words_of

BITS, BLOCKS, RADIUS = 256, 32, 72
NEAR = RADIUS // BLOCKS            # differing bits that the nearest block has at most
LEAST, OUT_OF = 3, 4               # similarity of 3/4 or more
ITEMS, ITEM_BYTES = 2000, 8 << 20  # of the benchmark in one block
STRIP = 1 << 14                    # shingles whose bits are summed at once
SWEEP = 1 << 18                    # shared shingles counted at once, whole items
SALTS = odd_numbers(BITS // 64, 3)


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """A row of 256 zeros and ones for each shingle."""
    words = np.stack([mix(shingles ^ s) for s in SALTS], axis=1)
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1)


def sequences(words: np.ndarray, borders: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``n`` < 5 words inside a text, equal to the text's shingle."""
    first = np.flatnonzero(np.arange(len(words)) + n <= np.repeat(borders[1:], np.diff(borders)))
    pairs = np.stack([first, first + n], axis=1)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), first
    flat = words.take((first[:, None] + np.arange(n)).ravel())
    hashes, _ = shingles_of(flat, np.arange(len(pairs) + 1) * n)
    return hashes, first


def nearest_repeat(shingles: np.ndarray, cuts: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Least distance of two equal shingles in each text, for the texts that hold ``hits``."""
    held = np.zeros(len(cuts) - 1, dtype=bool)
    held[np.searchsorted(cuts, hits, "right") - 1] = True
    place = np.flatnonzero(np.repeat(held, np.diff(cuts)))
    row = np.searchsorted(cuts, place, "right") - 1
    order = np.lexsort((shingles[place], row))
    place, row = place[order], row[order]
    same = np.flatnonzero((shingles[place][1:] == shingles[place][:-1]) & (row[1:] == row[:-1]))
    gap = np.full(len(cuts) - 1, np.iinfo(np.int64).max)
    np.minimum.at(gap, row[same], place[same + 1] - place[same])
    return gap


class Benchmark:
    """Index of a block of items."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        words, borders = words_of(pa.array(texts, pa.string()))
        shingles, cuts = shingles_of(words, borders)
        self.ids, self.words = ids, np.diff(borders)
        self.parts = [shingles[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.count = np.diff(cuts)
        self.bags = [Counter(p.tolist()) for p in self.parts]
        # shingle -> items that have it
        owner = np.repeat(np.arange(len(ids)), self.count)
        pairs, self.amount = (np.unique(np.stack([shingles, owner.astype(np.uint64)], axis=1), axis=0, return_counts=True)
                              if len(shingles) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)))
        self.keys, start = np.unique(pairs[:, 0], return_index=True)
        self.start = np.concatenate([start, [len(pairs)]])
        self.owner = pairs[:, 1].astype(np.int64)
        self.repeats = np.bincount(self.owner, weights=self.amount > 1, minlength=len(ids)) > 0
        self.prints = np.zeros((len(ids), BITS // 8), dtype=np.uint8)
        for i, p in enumerate(self.parts):
            if len(p):
                self.prints[i] = np.packbits(2 * bits_of(p).sum(axis=0, dtype=np.int64) > len(p))
        self.short = sorted({int(n) for n in self.words if 0 < n < SHINGLE})
        self.sizes = {int(n): np.flatnonzero(self.words == n) for n in set(self.words.tolist()) if n >= SHINGLE}
        self.index = {n: self._index(items) for n, items in self.sizes.items()}

    def _index(self, items: np.ndarray) -> np.ndarray:
        """[block, value] -> bit set of the items of which this block is at most NEAR bits away."""
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[None, :, None] ^ self.prints[items].T[:, None, :])
        return np.packbits(apart <= NEAR, axis=2)

    def matches(self, texts: pa.Array) -> list[tuple[int, int, float, int]]:
        """(row, item, similarity, first word) of every pair that matches, at its best window."""
        words, borders = words_of(texts)
        shingles, cuts = shingles_of(words, borders)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for n in self.short:
            hashes, first = sequences(words, borders, n)
            at = np.flatnonzero(np.isin(hashes, self.keys))
            for h, w in zip(hashes[at].tolist(), first[at].tolist(), strict=True):
                row = int(np.searchsorted(borders, w, "right")) - 1
                for item in self._items(h):
                    if self.words[item] == n:
                        best.setdefault((row, item), (1.0, w - int(borders[row])))
        if len(self.keys) and len(shingles):
            slot = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
            hits = np.flatnonzero(self.keys[slot] == shingles)
            if len(hits):
                many = np.diff(self.start)[slot[hits]]
                at = np.repeat(hits, many)
                pair = np.repeat(self.start[slot[hits]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
                item = self.owner.take(pair)
                gap = nearest_repeat(shingles, cuts, hits)
                exact = self.repeats[item] | (gap.take(np.searchsorted(cuts, at, "right") - 1) < self.count[item])
                exact &= self.words[item] >= SHINGLE
                self._sweep(at[exact], pair[exact], slot, cuts, best)
                at, item = at[~exact], item[~exact]
                for n in self.sizes:
                    self._windows(n, np.unique(at[self.words[item] == n]), shingles, cuts, best)
        return [(row, item, sim, at) for (row, item), (sim, at) in best.items()]

    def _items(self, key: int) -> list[int]:
        i = int(np.searchsorted(self.keys, np.uint64(key)))
        return self.owner[self.start[i]: self.start[i + 1]].tolist()

    def _sweep(self, at: np.ndarray, pair: np.ndarray, slot: np.ndarray, cuts: np.ndarray, best: dict) -> None:
        """Best window of every document and item of the shared shingles (place, pair of shingle and item).

        The r-th place of a shingle that the item has c times adds to the sum of minima of the windows
        that hold it, but not the place c places before: an interval of first shingles.
        """
        order = np.lexsort((at, slot[at], self.owner[pair]))
        at, pair = at[order], pair[order]
        item = self.owner[pair]
        borders = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
        a = 0
        while a < len(borders) - 1:
            b = max(a + 1, int(np.searchsorted(borders, borders[a] + SWEEP, "right")) - 1)
            self._sums(at[borders[a]: borders[b]], pair[borders[a]: borders[b]], cuts, best)
            a = b

    def _sums(self, at: np.ndarray, pair: np.ndarray, cuts: np.ndarray, best: dict) -> None:
        item, count, row = self.owner[pair], self.amount[pair], np.searchsorted(cuts, at, "right") - 1
        size, here = self.count[item], np.arange(len(at))
        new = (np.diff(pair, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0)
        chain = np.maximum.accumulate(np.where(new, here, 0))
        before = np.where(here - count >= chain, at[np.maximum(here - count, 0)] + 1, 0)
        lo = np.maximum(np.maximum(at - size + 1, cuts[row]), before)
        hi = np.minimum(at, np.maximum(cuts[row + 1] - size, cuts[row]))
        some = lo <= hi
        wide = int(cuts[-1]) + 1
        edge = np.concatenate([item[some] * wide + lo[some], item[some] * wide + hi[some] + 1])
        step = np.repeat([1, -1], int(some.sum()))
        order = np.argsort(edge, kind="stable")
        edge, both = edge[order], np.cumsum(step[order])
        last = np.append(np.diff(edge) > 0, True)[: len(edge)]
        edge, both = edge[last], both[last]
        edge, both = edge[both > 0], both[both > 0]
        item, first = edge // wide, edge % wide
        row = np.searchsorted(cuts, first, "right") - 1
        union = np.minimum(self.count[item], np.diff(cuts)[row]) + self.count[item] - both
        good = np.flatnonzero(OUT_OF * both >= LEAST * union)
        good = good[np.lexsort((first[good], -both[good], row[good], item[good]))]
        good = good[(np.diff(item[good], prepend=-1) != 0) | (np.diff(row[good], prepend=-1) != 0)]
        for r, i, sim, w in zip(row[good].tolist(), item[good].tolist(), (both[good] / union[good]).tolist(),
                                (first[good] - cuts[row[good]]).tolist(), strict=True):
            best[r, i] = (sim, w)

    def _windows(self, n: int, hits: np.ndarray, shingles: np.ndarray, cuts: np.ndarray, best: dict) -> None:
        """Fingerprint the windows of ``n`` words around ``hits`` and compare the candidates."""
        if not len(hits):
            return
        size = n - SHINGLE + 1
        row = np.searchsorted(cuts, hits, "right") - 1
        # first shingles of all windows that hold a hit, inside the document
        lo = np.maximum(hits - size + 1, cuts[row])
        hi = np.maximum(np.minimum(hits, cuts[row + 1] - size), cuts[row])
        edge = np.zeros(len(shingles) + 1, dtype=np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, np.maximum(hi, lo) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge) > 0)
        owner = np.searchsorted(cuts, starts, "right") - 1
        stops = np.minimum(starts + size, cuts[owner + 1])
        runs = np.flatnonzero(np.diff(starts, prepend=-2 - size) > size)      # strips that share no shingle
        ends = np.append(runs[1:], len(starts))
        a = 0
        while a < len(runs):
            b = a + 1
            while b < len(runs) and starts[ends[b] - 1] - starts[runs[b]] + (ends[b] - runs[a]) + size * (b - a) < STRIP:
                b += 1
            self._strip(n, starts[runs[a]: ends[b - 1]], stops[runs[a]: ends[b - 1]], owner[runs[a]: ends[b - 1]], shingles, cuts, best)
            a = b

    def _strip(self, n: int, starts: np.ndarray, stops: np.ndarray, owner: np.ndarray, shingles: np.ndarray,
               cuts: np.ndarray, best: dict) -> None:
        for k in range(0, len(starts), STRIP):
            first, stop, row = starts[k: k + STRIP], stops[k: k + STRIP], owner[k: k + STRIP]
            used = np.zeros(int(stop.max() - first[0]) + 1, dtype=np.int32)
            np.add.at(used, first - first[0], 1)
            np.add.at(used, stop - first[0], -1)
            place = np.flatnonzero(np.cumsum(used) > 0) + first[0]              # the shingles of these windows
            sums = np.zeros((len(place) + 1, BITS), dtype=np.int32)
            np.cumsum(bits_of(shingles[place]), axis=0, dtype=np.int32, out=sums[1:])
            lo = np.searchsorted(place, first)
            length = stop - first
            prints = np.packbits(2 * (sums[lo + length] - sums[lo]) > length[:, None], axis=1)
            items = self.sizes[n]
            near = np.bitwise_or.reduce([self.index[n][b][prints[:, b]] for b in range(BLOCKS)])
            window, which = np.nonzero(np.unpackbits(near, axis=1, count=len(items)))
            apart = np.bitwise_count(prints[window] ^ self.prints[items[which]]).sum(axis=1)
            for w, i in zip(window[apart <= RADIUS].tolist(), items[which[apart <= RADIUS]].tolist(), strict=True):
                bag = Counter(shingles[first[w]: stop[w]].tolist())
                both = sum(min(c, bag[s]) for s, c in self.bags[i].items() if s in bag)
                union = int(length[w]) + int(self.count[i]) - both
                if OUT_OF * both >= LEAST * union:
                    key, found = (int(row[w]), i), (both / union, int(first[w] - cuts[row[w]]))
                    old = best.get(key)
                    if old is None or (found[0], -found[1]) > (old[0], -old[1]):
                        best[key] = found


def benchmark_blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Benchmark]:
    """The benchmark in blocks of at most ITEMS items and about ITEM_BYTES bytes, one at a time."""
    ids, texts, size = [], [], 0
    for item in bench.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        if ids and (len(ids) == ITEMS or size + len(item["text"] or "") > ITEM_BYTES):
            yield Benchmark(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(item["id"])
        texts.append(item["text"])
        size += len(item["text"] or "")
    if ids:
        yield Benchmark(ids, texts)


def benchmark_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word): each document and item that match, at the best window."""
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key, item = rows.schema["doc_id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {key}, item_id {item}, similarity double, first_word long"
    found = spark.createDataFrame([], schema)
    for block in benchmark_blocks(bench):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            give_back()
            for b in batches:
                hits = shared.value.matches(b.column(1))
                if hits:
                    row, which, sim, at = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row)), pa.array([shared.value.ids[i] for i in which]),
                         pa.array(sim, pa.float64()), pa.array(at, pa.int64())],
                        names=["doc_id", "item_id", "similarity", "first_word"])

        found = found.union(rows.mapInArrow(search, schema))
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("at"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.similarity", (-F.col("m.at")).alias("first_word"))


def decontaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    arrow_limits(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block in benchmark_blocks(bench):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            give_back()
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[hit[0] for hit in shared.value.matches(b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
