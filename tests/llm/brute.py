"""Plain versions of the operators, for small tables only."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    key &= 2**64 - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def crc(text):
    return None if text is None else zlib.crc32(text.encode())


def repeats(rows, window):
    """(doc_id, n_words, n_removed, sha) for each row."""
    words = [(t or "").encode().split() for _, t in rows]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def groups(rows, k, percent):
    """(doc_id, n_shingles, component_id) for each row; all pairs are compared."""
    sets = [shingles(t, k) for _, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            a, b = rows[i][0], rows[j][0]
            if a is None or b is None:
                continue
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)]


def quality(text):
    w = (text or "").encode().split()
    ws = [x.decode() for x in w]
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if n[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(w), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
        len(w) < 20 or 100 * len(hit) > 30 * len(w),
    )
