"""Brute-force reference implementations for tests (plain Python, exact
double arithmetic as in the SQL definition)."""

import math


def neighbours(values, r):
    """Neighbour count per index (self excluded, abs(a-b) <= r in double)."""
    return [sum(1 for j, b in enumerate(values) if j != i and abs(a - b) <= r) for i, a in enumerate(values)]


def count_windows(ids, size, slide):
    """window number -> member indices, windows start on multiples of slide."""
    out = {}
    for i, x in enumerate(ids):
        lo = (x - size) // slide + 1
        hi = x // slide
        for kk in range(lo, hi + 1):
            e = kk + size // slide if size % slide == 0 else kk
            out.setdefault(e, []).append(i)
    return out


def window_counts(ids, values, size, slide, r, k):
    res = {}
    for e, idx in count_windows(ids, size, slide).items():
        vals = [values[i] for i in idx]
        nb = neighbours(vals, r)
        res[e] = sum(1 for n in nb if n < k)
    return res


def euclid(a, b):
    n = min(len(a), len(b))
    s = 0.0
    for i in range(n):
        d = float(a[i]) - float(b[i])
        s += d * d
    return math.sqrt(s)
