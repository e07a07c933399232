"""Signature trees: all links of a group of shingle sets by dual traversal.

A node holds the OR of its sets' bitmaps, the range of their sizes and the largest number of
tokens that share a bit with another.  Two nodes can hold a linked pair only if

* their size ranges admit a Jaccard similarity of 3/4, and
* the bits that both have, plus the smaller of the two bit collisions, reach the overlap that
  the two smallest sizes need.

Both tests only ever exclude pairs that cannot link.  What is left at the leaves is compared
exactly.  Nodes of which all sets are already in one component are passed over: this keeps
the components and makes a group of near copies cost as many comparisons as it has sets.

A group whose bitmaps would be large is not one tree: ``spanning_links`` goes through its size
classes in ascending order with a tree over as many neighbouring classes (two at least) as fit.  A
bitmap is as wide as the longest set of its tree needs, so one long set does not widen all others.
"""

from __future__ import annotations

import numpy as np

FAN = 8
BITMAP_BYTES = 32 << 20    # bitmaps of a tree's leaves, where it has more than two size classes
NO_BORDER = np.iinfo(np.int64).max


def linked(inter: int, a: int, b: int) -> bool:
    """100 * intersection >= 75 * union for sets of sizes a and b."""
    return 7 * inter >= 3 * (a + b)


def bitmap_width(longest: int) -> int:
    """Bits for sets of up to ``longest`` tokens."""
    width = 256
    while width < min(1 << 16, 2 * longest):
        width *= 2
    return width


def class_borders(largest: int) -> np.ndarray:
    """Least size of each size class, and a border above ``largest``.

    A border is at least 4/3 of the one before, so a set links with sets of its own class and of the
    two beside it only.
    """
    out = [1]
    while out[-1] <= largest:
        out.append(-(-4 * out[-1] // 3))
    return np.array(out, dtype=np.int64)


def spanning_links(tokens: list[np.ndarray], sizes: np.ndarray, labels: list, bitmap_bytes: int = BITMAP_BYTES) -> list[tuple[int, int]]:
    """Links that, with the equal ``labels``, span every component of the sets; trees are bounded by bytes."""
    order = np.argsort(sizes, kind="stable")
    borders = class_borders(int(sizes.max(initial=1)))
    cuts = np.searchsorted(sizes[order], borders)
    classes = len(borders) - 1
    longest = [max((len(tokens[i]) for i in order[a:b]), default=0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    joined, out, at = Joined(len(tokens)), [], 0
    joined.join_known(labels)
    while at < classes:
        if cuts[at] == cuts[at + 1]:
            at += 1
            continue
        end = min(at + 2, classes)
        while end < classes and (cuts[end + 1] - cuts[at]) * (bitmap_width(max(longest[at:end + 1])) >> 3) <= bitmap_bytes:
            end += 1
        group = order[cuts[at]:cuts[end]]
        if len(group) > 1:
            # pairs inside the last class wait for the next tree, which begins with it
            tree = SignatureTree([tokens[i] for i in group], sizes[group], NO_BORDER if end == classes else int(borders[end - 1]))
            tree.join_known([joined.find(i) for i in group.tolist()])
            found = [(int(group[a]), int(group[b])) for a, b in tree.links()]
            for a, b in found:
                joined.union(a, b)
            out += found
        at = classes if end == classes else end - 1
    return out


class Joined:
    """Which of ``n`` sets are in one component."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def join_known(self, labels: list) -> None:
        """Sets with equal labels are in one component already."""
        first: dict = {}
        for i, label in enumerate(labels):
            if label is not None:
                self.union(first.setdefault(label, i), i)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class SignatureTree(Joined):
    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray, border: int = NO_BORDER) -> None:
        """``tokens``: sorted distinct uint64; ``sizes``: whole set sizes (tokens that no other
        set has may be left out of ``tokens``).  Two sets of ``border`` or more are not compared."""
        super().__init__(len(tokens))
        self.tokens, self.size, self.border = tokens, sizes, border
        n = len(tokens)
        lead = np.array([int(t[0]) if len(t) else 0 for t in tokens], dtype=np.uint64)
        order = np.lexsort((lead, sizes))
        width = bitmap_width(max((len(t) for t in tokens), default=1))
        bits = np.zeros((n, width >> 6), dtype=np.uint64)
        for row, t in enumerate(tokens):
            at = (t & np.uint64(width - 1)).astype(np.int64)
            np.bitwise_or.at(bits[row], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        extra = np.array([len(t) for t in tokens]) - np.bitwise_count(bits).sum(axis=1)
        # levels of nodes, each level's nodes being runs of FAN of the level below; leaf i is set order[i]
        self.leaf = order
        self.bits, self.low, self.high, self.extra = [bits[order]], [sizes[order]], [sizes[order]], [extra[order]]
        while len(self.low[-1]) > 1:
            cuts = np.arange(0, len(self.low[-1]), FAN)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], cuts, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], cuts))
            self.high.append(np.maximum.reduceat(self.high[-1], cuts))
            self.extra.append(np.maximum.reduceat(self.extra[-1], cuts))
        self.whole: list[list[int]] = [list(order)] + [[-1] * len(x) for x in self.low[1:]]  # a member, if all are joined

    def _children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FAN, min((node + 1) * FAN, len(self.low[level - 1])))

    def _joined(self, level: int, a: int, b: int) -> bool:
        x, y = self.whole[level][a], self.whole[level][b]
        return x >= 0 and y >= 0 and self.find(x) == self.find(y)

    def _survivors(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which node pairs of a level may hold a linked pair (matrix)."""
        low, high, extra, bits = self.low[level], self.high[level], self.extra[level], self.bits[level]
        sizes = (4 * high[a][:, None] >= 3 * low[b][None, :]) & (4 * high[b][None, :] >= 3 * low[a][:, None])
        sizes &= np.minimum(low[a][:, None], low[b][None, :]) < self.border
        both = np.bitwise_count(bits[a][:, None, :] & bits[b][None, :, :]).sum(axis=2, dtype=np.int64)
        most = both + np.minimum(extra[a][:, None], extra[b][None, :])
        return sizes & (7 * most >= 3 * (low[a][:, None] + low[b][None, :]))

    def links(self) -> list[tuple[int, int]]:
        """Links that join components; together they span every component of the group."""
        out: list[tuple[int, int]] = []
        if len(self.tokens) > 1:
            self._visit(len(self.low) - 1, 0, 0, out)
        return out

    def _visit(self, level: int, a: int, b: int, out: list) -> None:
        below = level - 1
        left, right = self._children(level, a), self._children(level, b)
        if a == b and below:
            for c in left[self.low[below][left] < self.border].tolist():
                self._visit(below, c, c, out)
        pairs = np.argwhere(self._survivors(below, left, right))
        for i, j in pairs.tolist():
            c, d = int(left[i]), int(right[j])
            if a == b and c >= d or self._joined(below, c, d):
                continue
            if below:
                self._visit(below, c, d, out)
            else:
                x, y = int(self.leaf[c]), int(self.leaf[d])
                inter = len(np.intersect1d(self.tokens[x], self.tokens[y], assume_unique=True))
                if linked(inter, int(self.size[x]), int(self.size[y])) and self.union(x, y):
                    out.append((x, y))
        for node in {a, b}:
            kids = [self.whole[below][c] for c in self._children(level, node).tolist()]
            if min(kids) >= 0 and len({self.find(k) for k in kids}) == 1:
                self.whole[level][node] = kids[0]
