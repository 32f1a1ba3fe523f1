"""The contracts of the operators said again in plain Python loops, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict


def sentence(seed, n):
    """n invented words that depend on the seed only."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("".join("bcdfglmnprst"[(x >> s) % 12] + "aeiou"[(x >> s) % 5] for s in (4, 9, 14)))
    return " ".join(out)


def split_words(text):
    return (text or "").encode().split()


def suffix_dedup(docs, length=200):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, kept))
    return out


def window_dedup(docs, size=50):
    first = {}
    rank = lambda i: float("inf") if i is None else i
    for i, t in docs:
        w = split_words(t)
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, float("inf")), rank(i))
    out = []
    for i, t in docs:
        w = split_words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < rank(i):
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near_duplicates(docs):
    sets = {i: shingle_set(t) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and (c.isdigit() or "a" <= c <= "z") or not c.isascii() else " " for c in lower).split(" ")


def contaminated(docs, items, size=13):
    windows = defaultdict(set)
    for ident, text in items:
        w = [x for x in terms(text) if x]
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("" if ident is None else str(ident))
    lengths = {len(g) for g in windows}
    out = []
    for i, t in docs:
        w = [x for x in terms(t) if x]
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()
