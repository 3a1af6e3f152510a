"""The nearest objects of a block, bounded by the nearest so far, against brute force."""

import numpy as np
import pandas as pd
import pytest

from brute import euclid
from sparkdod.operators import blocks
from sparkdod.operators.search import knn_join, radius_topk


def ragged(rng, n, most, even):
    return [np.round(rng.normal(0, 1, most if even else rng.integers(0, most + 1)), 1) + (100 if i % 10 == 9 else 0) for i in range(n)]


@pytest.mark.parametrize("even", [(True, True), (False, True), (False, False)])
def test_nearest_of_a_block_of_prefixes(even, monkeypatch):
    monkeypatch.setattr(blocks, "TILE_ROWS", 16)
    monkeypatch.setattr(blocks, "FIRST_TILE", 3)
    rng = np.random.default_rng(4)
    for trial in range(12):
        most = int(rng.choice([1, 3, 8]))
        q, d = ragged(rng, 40, most, even[0]), ragged(rng, 70, most, even[1])
        qid, did = rng.permutation(100)[:40], rng.permutation(100)[:70]
        r = float(rng.choice([0.0, 0.5, 2.0, 1e4]))
        found = blocks._block_nearest(pd.DataFrame({"query_id": qid, "qvec": q}), pd.DataFrame({"neighbor_id": did, "dvec": d}), r, 4, trial % 2 == 0)
        want = {int(i): sorted((euclid(v, u), int(j)) for j, u in zip(did, d) if euclid(v, u) <= r and (trial % 2 == 0 or i != j))[:4] for i, v in zip(qid, q)}
        got = {int(i): [] for i in qid}
        for x in found.itertuples():
            got[x.query_id].append((x.distance, x.neighbor_id))
        assert got == want


def test_few_pairs_of_a_block_get_exact_sums(monkeypatch):
    rng = np.random.default_rng(5)
    q = [rng.normal(0, 1, i % 32 + 1) for i in range(600)]
    d = [rng.normal(0, 1, 32) for _ in range(3_000)]
    exact, sums = blocks._prefix_distances, []
    monkeypatch.setattr(blocks, "_prefix_distances", lambda *x: sums.append(len(x[-1])) or exact(*x))
    found = blocks._block_nearest(pd.DataFrame({"query_id": range(600), "qvec": q}), pd.DataFrame({"neighbor_id": range(3_000), "dvec": d}), 1e6, 3, True)
    assert len(found) == 1_800 and sum(sums) < 0.06 * 600 * 3_000


def test_too_large_for_a_product():
    q, d = pd.DataFrame({"query_id": [1], "qvec": [[1e200, 0.0]]}), pd.DataFrame({"neighbor_id": [2], "dvec": [[1.0]]})
    assert blocks._block_nearest(q, d, 1.0, 1, True) is None


def test_ragged_join_and_short_counts(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(ragged(rng, 90, 4, False)) if len(v)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    want = []
    for i, v in rows:
        want += [(i, j, e, n + 1) for n, (e, j) in enumerate(sorted((euclid(v, u), j) for j, u in rows if j != i)[:3])]
    assert sorted(map(tuple, knn_join(df, df, 3).select("query_id", "neighbor_id", "distance", "rank").collect())) == sorted(want)
    whole = {i: sum(euclid(v, u) <= 1.0 for _, u in rows) for i, v in rows}
    for counts in (True, False):
        got = {r[0]: r[1] for r in radius_topk(df, df, 1.0, 3, counts=counts, block_rows=20).groupBy("query_id").sum("n").collect()}
        assert (got == whole) if counts else all(min(n, 3) <= got[i] <= n for i, n in whole.items())
