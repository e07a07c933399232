"""Plain versions of the operators to compare with."""

import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(w):
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def near_components(docs):
    """{doc_id: (set size, smallest linked id)} for unique non-null ids."""
    sets = {i: set(shingles(words(t))) for i, t in docs}
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in {b for x in sets[a] for b in held[x] if b > a}:
            inter = len(sets[a] & sets[b])
            if 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def leaks(docs, items):
    """{(doc_id, item_id): (similarity, first word)} over every window of the item's size."""
    out = {}
    bags = [(i, words(t)) for i, t in items]
    for d, text in docs:
        w = words(text)
        have = set(shingles(w))
        for i, item in bags:
            if not item or not w or len(item) >= 5 and not have & set(shingles(item)):
                continue
            bag = Counter(shingles(item))
            for s in range(max(1, len(w) - len(item) + 1)):
                here = Counter(shingles(w[s:s + len(item)]))
                both = sum((here & bag).values())
                union = sum(here.values()) + sum(bag.values()) - both
                if 4 * both >= 3 * union and (both / union, -s) > out.get((d, i), (0, 0)):
                    out[d, i] = (both / union, -s)
    return {k: (v, -s) for k, (v, s) in out.items()}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def auc(pairs):
    """Area under the curve of (score, label) pairs."""
    ranked = sorted(pairs)
    at = Counter(s for s, _ in ranked)
    rank, seen = {}, 0
    for s, n in sorted(at.items()):
        rank[s] = seen + (n + 1) / 2
        seen += n
    pos = [s for s, y in ranked if y]
    neg = len(ranked) - len(pos)
    return (sum(rank[s] for s in pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * neg)
