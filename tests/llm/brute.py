"""Plain-Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def near_duplicates(rows):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component)}"""
    sets = {d: shingle_set(t) for d, t in rows}
    lists = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            lists[g].append(d)
    shared = Counter(p for own in lists.values() for p in itertools.combinations(own, 2))
    comp = Sets(sets)
    for (a, b), c in shared.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            comp.join(a, b)
    return {d: (len(s), comp.find(d)) for d, s in sets.items()}


def line_dedup(rows):
    """[(doc_id, text)] -> [(doc_id, n_lines, n_dropped, kept)]"""
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and d != min(holders[key(x)]))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def usable(v, zero_ok=False):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zero_ok or any(v))


def vector_links(rows, threshold=0.9):
    """[(id, vector)] -> [(id, n_links, component)] by all pairs."""
    comp = Sets({i for i, _ in rows if i is not None})
    n = [0] * len(rows)
    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if i is not None and usable(v) else None for i, v in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
            n[a] += 1
            n[b] += 1
            comp.join(rows[a][0], rows[b][0])
    return [(i, n[k], None if i is None else comp.find(i)) for k, (i, _) in enumerate(rows)]


def top_k(rows, is_query, k=20, scale=64):
    """[(id, vector)] -> {query_id: [(vec_id, score)]}"""
    own = {(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if i is not None and usable(v, True)}
    out = {}
    for q, e in own:
        if is_query(q):
            s = sorted({(-sum(a * b for a, b in zip(e, f, strict=True)), c) for c, f in own if c != q and len(f) == len(e)})
            out[q] = [(c, -x) for x, c in s[:k]]
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """{source: size} -> {source: target}"""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        left = budget - sum(limit * sizes[s] for s in capped)
        total = sum(w[s] for s in order if s not in capped)
        goal = {s: limit * sizes[s] if s in capped else left * w[s] / total for s in order}
        over = {s for s in order if s not in capped and goal[s] > limit * sizes[s] + 1e-9}
        if not over:
            return goal
        capped |= over


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0
