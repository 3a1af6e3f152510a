"""Outliers of vectors: points with enough neighbours leave the counting early, the counts of the others are whole."""

import random

import pytest

from sparkdod.functions.block_metrics import chebyshev_blocks, euclidean_blocks, manhattan_blocks
from sparkdod.operators import metric_search as ms
from sparkdod.operators.windows import Windows

METRICS = {"manhattan": (manhattan_blocks, lambda a, b: sum(abs(x - y) for x, y in zip(a, b))),
           "chebyshev": (chebyshev_blocks, lambda a, b: max(abs(x - y) for x, y in zip(a, b))),
           "euclidean": (euclidean_blocks, lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5)}


@pytest.fixture
def asked(monkeypatch):
    """Numbers of queries that are sent to look for objects, in order."""
    seen, visits = [], ms.PivotIndex.visits
    monkeypatch.setattr(ms.PivotIndex, "visits", lambda self, queries, *x: seen.append(queries.count()) or visits(self, queries, *x))
    return seen


def points(dims, n, seed):
    rnd = random.Random(seed)
    out = [(i, [rnd.choice([-6.0, 6.0]) + rnd.randint(-4, 4) / 4 for _ in range(dims)] if i % 3 else [rnd.uniform(-60, 60) for _ in range(dims)]) for i in range(n)]
    return out + [(n + i, [1e12] * dims) for i in range(12)] + [(n + 20 + i, [50.0] * dims) for i in range(9)]


def brute(data, windows, radius, k, dist):
    size, slide = windows or (10 ** 9, 10 ** 9)
    few, counts = {}, {}
    for start in range(slide - size, max(i for i, _ in data) + 1, slide):
        inside = [(i, v) for i, v in data if start <= i < start + size]
        for i, v in inside:
            n = sum(dist(u, v) <= radius for _, u in inside) - 1
            counts[start] = counts.get(start, 0) + (n < k)
            if n < k:
                few[((start + size) // slide, i)] = n
    return few, {(start + size) // slide: n for start, n in counts.items()}


@pytest.mark.parametrize("name", sorted(METRICS))
def test_outliers_by_growing_numbers_of_witnesses(spark, name, asked, monkeypatch):
    monkeypatch.setattr(ms, "WITNESSES", 30)
    monkeypatch.setattr(ms, "MORE_WITNESSES", 3)
    blocks, dist = METRICS[name]
    data = [(i, v + [0.0] * 2) for i, v in points(2, 400, 3)]  # too many coordinates for cubes
    df = spark.createDataFrame(data, "id long, vec array<double>")
    want = {i: n for (_, i), n in brute(data, None, 3.0, 5, dist)[0].items()}
    assert dict(map(tuple, ms.metric_outliers(df, 3.0, 5, metric=blocks, pivots=8).collect())) == want
    assert 10 < len(want) < len(data) / 2
    assert len(asked) > 2 and asked[-1] < asked[0] / 2


@pytest.mark.parametrize("name", sorted(METRICS))
def test_window_outliers_leave_out_full_cubes(spark, name, asked):
    blocks, dist = METRICS[name]
    data = points(2, 900, 4)
    df = spark.createDataFrame(data, "id long, vec array<double>")
    few, counts = brute(data, (600, 300), 3.0, 4, dist)
    w = Windows.count(600, 300)
    got = ms.window_outliers_nd(df, w, 3.0, 4, metric=blocks, pivots=8)
    assert {(r.window_end, r.id): r.neighbors for r in got.collect()} == few
    assert len(few) > 100 and asked[-1] < 0.6 * len(data)
    assert dict(map(tuple, ms.window_outlier_counts_nd(df, w, 3.0, 4, metric=blocks, pivots=8).collect())) == counts


def test_points_of_a_cube_are_within_the_radius(spark):
    rnd = random.Random(9)
    for name, (blocks, dist) in METRICS.items():
        data = [(i, [x, y]) for i, (x, y) in enumerate((rnd.choice([0, 1e3, 4e5]) + rnd.random() * 3, -rnd.random() * 3) for _ in range(300))]
        ids = spark.createDataFrame([(i, v, 0, 1) for i, v in data], "query_id long, obj array<double>, src long, mult long")
        got = ms._cube_counts(ids, 2.0 * blocks.cube(2), 3).collect()
        assert got
        for r in got:
            assert 3 < r.n <= sum(dist(data[r.query_id][1], v) <= 2.0 for _, v in data), name
