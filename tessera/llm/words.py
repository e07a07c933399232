"""Words and hashed word shingles of whole Arrow batches, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A word's hash is a sum of its bytes
times pseudo-random odd numbers by position, then mixed; a shingle's hash is the mixed sum of
its words' hashes times odd numbers by place.  Both are 64 bits wide.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

SHINGLE = 5
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are the public splitmix64 ones)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + U(seed << 32)) | U(1)


_PLACES = odd_numbers(1 << 12, 1)


def byte_set(*which: int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(which)] = True
    return out


WHITE = byte_set(0x20, *range(0x09, 0x0E))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and each text's border in them (n + 1 numbers)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]: offsets[-1]] if raw else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 byte of every word, and the border of each text's words."""
    black = ~between.take(data)
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True                      # a text's border ends a word
    begins = black.copy()
    begins[1:] &= ~black[:-1] | cut[1:-1]
    stops = black.copy()
    stops[:-1] &= ~black[1:] | cut[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return first, last, np.searchsorted(first, offsets)


_LOWER = np.arange(256, dtype=np.uint64) + U(1)
_LOWER[0x41:0x5B] += U(32)


PIECE = 1 << 21     # bytes of words that are hashed at once


def hash_words(data: np.ndarray, first: np.ndarray, last: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hash of every word, then of every word's first 4, 5, ... bytes where asked for.

    Words of at most that many bytes are their own prefix.
    """
    parts = [[np.zeros(0, dtype=np.uint64)] for _ in range(1 + len(prefixes))]
    total = np.cumsum(last - first)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PIECE, "right")))
        for part, h in zip(parts, _hash_piece(data, first[lo:hi], last[lo:hi], prefixes), strict=True):
            part.append(h)
        lo = hi
    return [np.concatenate(part) for part in parts]


def _hash_piece(data: np.ndarray, first: np.ndarray, last: np.ndarray, prefixes: tuple[int, ...]) -> list[np.ndarray]:
    size = last - first
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    places = _PLACES if size.max() <= len(_PLACES) else odd_numbers(int(size.max()), 1)
    inside = _LOWER.take(data.take(place + np.repeat(first, size))) * places.take(place)
    if not prefixes:
        return [mix(np.add.reduceat(inside, at))]
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(inside)])
    return [mix(total[at + n] - total[at]) for n in (size, *(np.minimum(size, p) for p in prefixes))]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the batch, and the border of each text's words (n + 1 numbers)."""
    data, offsets = utf8(texts)
    first, last, borders = spans(data, offsets)
    return hash_words(data, first, last)[0], borders


def pieces(text: str, size: int) -> list[str]:
    """``text`` cut into pieces of about ``size`` characters, always before a blank or newline that
    follows a visible ASCII character.  Without such a place there is no cut."""
    out, lo = [], 0
    while len(text) - lo > size:
        cut = _CUT.search(text, lo + size)
        if not cut:
            break
        out.append(text[lo: cut.start()])
        lo = cut.start()
    return [*out, text[lo:]]


_CUT = re.compile(r"(?<=[!-~])[ \n]")
_ORDER = odd_numbers(SHINGLE, 2)


def shingles_of(words: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every 5-word shingle (a shorter text is one shingle) and each text's border."""
    n = np.diff(borders)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    out_borders = np.concatenate([[0], np.cumsum(count)])
    if not out_borders[-1]:
        return np.zeros(0, dtype=np.uint64), out_borders
    # the sum over five places; places beyond a short text's last word add nothing
    first = np.repeat(borders[:-1] - out_borders[:-1], count) + np.arange(out_borders[-1])
    stop = np.repeat(borders[1:], count)
    padded = np.concatenate([words, np.zeros(SHINGLE, dtype=np.uint64)])
    total = np.zeros(len(first), dtype=np.uint64)
    for j in range(SHINGLE):
        total += np.where(first + j < stop, padded.take(first + j) * _ORDER[j], U(0))
    return mix(total), out_borders
