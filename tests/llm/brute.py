"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=lambda x: x.translate(FOLD)):
    return [w for w in SPACE.split(lower(text or "")) if w]


def shingles(text, n):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def components(rows, n, num, den):
    """{id: smallest id reachable} of (id, text) rows, all pairs compared."""
    sets = defaultdict(list)
    for i, text in rows:
        sets[i].append(shingles(text, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = [(i, s) for i, ss in sets.items() for s in ss if s]
    for k, (i, a) in enumerate(every):
        for j, b in every[:k]:
            if den * min(len(a), len(b)) >= num * max(len(a), len(b)):
                both = len(a & b)
                if den * both >= num * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def leaks(docs, items, n=5, least=0.8):
    """{(doc, item): similarity} of the best of all windows of the item's size."""
    out = {}
    parts = {i: words(t, str.lower) for i, t in items}
    for doc, text in docs:
        w = words(text, str.lower)
        grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        for item, own in parts.items():
            want = Counter(tuple(own[k : k + n]) for k in range(len(own) - n + 1))
            if not want or not any(g in want for g in grams):
                continue
            size = len(own) - n + 1
            for at in range(max(1, len(grams) - size + 1)):
                have = Counter(grams[at : at + size])
                both = sum(min(c, want[g]) for g, c in have.items())
                share = both / (sum(have.values()) + size - both)
                if share >= least:
                    out[doc, item] = max(share, out.get((doc, item), 0))
    return out
