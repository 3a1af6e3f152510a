"""Centres of dense clusters, decided some turns at a time, against the greedy pass."""

import random
from hashlib import md5

import pytest

from sparkdod.functions.block_metrics import manhattan_blocks
from sparkdod.operators import metric_clusters as mc
from sparkdod.operators.windows import Windows


def manhattan(a, b):
    out = 0.0
    for x, y in zip(a, b):  # sum() carries a correction
        out += abs(x - y)
    return out


@pytest.mark.parametrize("size,slide", [(None, None), (160, 80)])
def test_centres_by_turns_are_those_of_the_greedy_pass(spark, monkeypatch, size, slide):
    monkeypatch.setattr(mc, "FIRST_TURNS", 12)
    monkeypatch.setattr(mc, "MORE_TURNS", 3)
    met, evaluate = [], mc.PivotIndex.evaluate

    def spy(self, visits, keys, kernel, schema, *x):
        if "turn" in schema:
            met.append(visits.select("query_id").distinct().count() * self.placed.count())
        return evaluate(self, visits, keys, kernel, schema, *x)
    monkeypatch.setattr(mc.PivotIndex, "evaluate", spy)
    rnd = random.Random(3)
    data = [(i, [rnd.gauss(0, 2) + 12 * (i % 2) for _ in range(4)]) for i in range(320)] + [(400, [0.0] * 4), (401, [0.0] * 4)]
    df = spark.createDataFrame(data, "id long, vec array<double>")
    radius, k, want = 8.0, 3, set()
    windows = Windows.count(size, slide) if size else None
    for start in range(slide - size, 402, slide) if size else [0]:
        inside = [(i, v) for i, v in data if not size or start <= i < start + size]
        dense, centres = [(i, v) for i, v in inside if sum(manhattan(v, u) <= radius / 2 for _, u in inside) > k and not (i == 401 and start <= 400)], []
        for i, v in sorted(dense, key=lambda x: md5(str(x[0]).encode()).hexdigest()):
            if all(manhattan(v, u) > radius / 2 for _, u in centres):
                centres.append((i, v))
        for i, v in inside:
            near = sorted((manhattan(v, u), c) for c, u in centres if manhattan(v, u) <= radius / 2)
            want.add(((start + size) // slide if size else 0, i, near[0][1] if near else None, near[0][0] if near else None))
    got = mc.assign_clusters_nd(df, windows, radius, k, metric=manhattan_blocks, pivots=6)
    assert set(map(tuple, got.collect())) == want
    assert len({x[2] for x in want if x[2] is not None}) > 8
    if not size:  # few candidates meet each other
        n = sum(sum(manhattan(v, u) <= radius / 2 for _, u in data) > k for _, v in data)
        assert len(met) > 3 and sum(met) < 0.7 * n * n
