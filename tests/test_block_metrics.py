"""Pairs within a limit, found by cheaper distances first, against the metric itself."""

import numpy as np
import pytest

from sparkdod.functions import block_metrics as bm
from sparkdod.functions.block_metrics import chebyshev_blocks, euclidean_blocks, manhattan_blocks, pairs_within

METRICS = [euclidean_blocks, manhattan_blocks, chebyshev_blocks]


def vectors(kind, n, dims, seed):
    rng = np.random.default_rng(seed)
    out = rng.normal(0, 0.1, (n, dims))
    if kind == "far":
        out += 1e12
    elif kind == "one far":
        out[0] = 1e9 * (-1) ** seed
    elif kind == "ties":
        out = np.round(out * 5)
    elif kind == "equal":
        out[:] = out[0]
    elif kind == "tiny":
        out *= 1e-300
    return out


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("kind", ["plain", "far", "one far", "ties", "equal", "tiny"])
def test_pairs_within_equal_the_metric(metric, kind):
    for dims, n, m in ((1, 9, 40), (3, 70, 1_100), (64, 40, 300)):
        a, b = vectors(kind, n, dims, 1), vectors(kind, m, dims, 2)
        full = metric(a, b)
        for q in (0, 0.01, 0.5, 1):  # limits that are distances themselves
            limit = np.quantile(full, q, axis=1, method="lower")
            rows, cols = np.nonzero(full <= limit[:, None])
            got = pairs_within(metric, a, b, limit)
            assert [x.tolist() for x in got] == [rows.tolist(), cols.tolist(), full[rows, cols].tolist()]
        assert len(pairs_within(metric, a, b, np.full(n, np.inf))[0]) == n * m
        assert len(pairs_within(metric, a, b, np.full(n, -1.0))[0]) == 0


@pytest.mark.parametrize("metric", METRICS[1:])
def test_few_pairs_meet_the_whole_metric(metric, monkeypatch):
    a, b = vectors("plain", 300, 64, 1), vectors("plain", 2_000, 64, 2)
    limit = np.quantile(metric(a, b), 0.001, axis=1)
    strips, sums = [], []
    by_strips, decided = bm._by_strips, bm._decided
    monkeypatch.setattr(bm, "_by_strips", lambda *x: strips.append(1) or by_strips(*x))
    monkeypatch.setattr(bm, "_decided", lambda a, b, limit, rows, *x: sums.append(len(rows)) or decided(a, b, limit, rows, *x))
    assert len(pairs_within(metric, a, b, limit)[0]) == 600
    assert not strips and sum(sums) < 0.02 * len(a) * len(b)
