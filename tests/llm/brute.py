"""Plain single-process versions of the operators, for comparison."""

import collections
import hashlib
import math


def key(i):
    return math.inf if i is None else i


def raw(t):
    return (t or "").encode()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def covered(items, length):
    """items: (id, sequence). Which positions a window covers that also
    starts under a smaller id; one list of flags per item."""
    first = {}
    for i, s in items:
        for k in range(len(s) - length + 1):
            w = s[k:k + length]
            if w not in first or key(i) < first[w]:
                first[w] = key(i)
    out = []
    for i, s in items:
        gone = bytearray(len(s))
        for k in range(len(s) - length + 1):
            if first[s[k:k + length]] < key(i):
                gone[k:k + length] = b"\1" * length
        out.append(gone)
    return out


def substring_rows(docs, length):
    items = [(i, raw(t)) for i, t in docs]
    for (i, s), gone in zip(items, covered(items, length)):
        spans = sum(1 for q in range(len(gone)) if gone[q] and (q == 0 or not gone[q - 1]))
        yield (i, len(s), sum(gone), spans, sha(bytes(c for c, g in zip(s, gone) if not g)))


def phrase_rows(docs, length):
    items = [(i, tuple(raw(t).split())) for i, t in docs]
    for (i, s), gone in zip(items, covered(items, length)):
        yield (i, len(s), sum(gone), sha(b" ".join(w for w, g in zip(s, gone) if not g)))


def shingles(t, size):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw(t)).split()
    if len(low) >= size:
        return frozenset(zip(*[low[k:] for k in range(size)]))
    return frozenset([tuple(low)] if low else [])


def near_rows(docs, size, num=80, den=100):
    """docs with distinct ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if i is not None and sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    for i in sets:
        c = find(i)
        yield (i, len(sets[i]), c, i is None or c == i)


def top_rows(vectors, k, every, scale=256):
    """vectors: distinct (id, list or None)."""
    ok = {i: [math.floor(scale * x) for x in v] for i, v in vectors
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q, a in ok.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok.items() if i != q)
            for r, (s, i) in enumerate(scores[:k], 1):
                yield (q, r, i, -s)


def grouped(rows):
    return collections.Counter(rows)
