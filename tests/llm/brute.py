"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict


class Groups:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def removed_bytes(rows, length):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] by looking every string up."""
    least: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            m = least.get(b[s : s + length])
            if m is not None and (i is None or m < i):
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed_words(rows, length):
    data = [(i, (t or "").encode().split()) for i, t in rows]
    n = Counter(tuple(w[s : s + length]) for _, w in data for s in range(len(w) - length + 1))
    out = []
    for i, w in data:
        gone = bytearray(len(w))
        for s in range(len(w) - length + 1):
            if n[tuple(w[s : s + length])] > 1:
                gone[s : s + length] = b"\1" * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) or frozenset([tuple(words)])


def linked(rows, per_cent=90):
    """[(doc_id, n_shingles, component_id)], each row linked by its own text."""
    sets = [(i, shingles(t)) for i, t in rows]
    groups, holders = Groups(), defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        for j, n in Counter(h for x in s for h in holders[x] if h < k).items():
            other, t = sets[j]
            if other is not None and 100 * n >= per_cent * (len(s) + len(t) - n):
                groups.join(k, j)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[groups.find(k)] = min(least.get(groups.find(k), i), i)
    return [(i, len(s), None if i is None else (least[groups.find(k)] if s else i)) for k, (i, s) in enumerate(sets)]
