"""Search operators against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brute import euclid
from sparkdod.operators import search
from sparkdod.operators.cells import grid_reach, grid_width
from sparkdod.operators.sampling import extremes, sample_n
from sparkdod.operators.search import (knn_join, knn_within, nearest_center, radius_join, rank_by_distance,
                                       snapshot_outliers_nd)


@pytest.fixture(scope="module")
def vecs(spark):
    rnd = random.Random(3)
    rows = [(i, [round(rnd.gauss(c, 1.0), 3) for _ in range(6)]) for i, c in enumerate([0, 0, 3, 3, 0, 6] * 10)]
    rows.append((999, [0.0, 0.0, 0.0]))  # shorter vector: distance over the shorter prefix
    return rows, spark.createDataFrame(rows, "id long, vec array<double>")


def brute_pairs(rows, r, self_=False):
    return {(a, b) for a, va in rows for b, vb in rows if (self_ or a != b) and euclid(va, vb) <= r}


def test_radius_join_nd(spark, vecs):
    rows, df = vecs
    got = {(x.query_id, x.neighbor_id) for x in radius_join(df, df, 2.5, include_self=False).collect()}
    assert got == brute_pairs(rows, 2.5)


def test_radius_join_includes_self_by_default(spark, vecs):
    rows, df = vecs
    got = {(x.query_id, x.neighbor_id) for x in radius_join(df, df, 1.0).collect()}
    assert got == brute_pairs(rows, 1.0, self_=True)


def test_radius_join_1d(spark):
    rnd = random.Random(1)
    vals = [round(rnd.uniform(0, 10), 2) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(vals)), "id long, value double")
    got = {(x.query_id, x.neighbor_id) for x in radius_join(df, df, 0.45, include_self=False).collect()}
    want = {(i, j) for i, a in enumerate(vals) for j, b in enumerate(vals) if i != j and abs(a - b) <= 0.45}
    assert got == want


@pytest.mark.parametrize("held", [2 ** 19, 40])
@pytest.mark.parametrize("own", [False, True])
def test_radius_join_deals_a_crowded_cell_to_many_tasks(spark, monkeypatch, held, own):
    monkeypatch.setattr(search, "HELD_ROWS", held)
    # 300 values in one cell, a few elsewhere; ids and rows repeat, one value is NULL, one key too
    rows = [(i % 290, 0.05 + i / 2000, i % 2) for i in range(300)] + [(1000 + i, 5.0 + i, 0) for i in range(20)] + [(3, 0.1, 1)] * 2
    odd = [(2000, None, 0), (2001, 0.1, None)]
    df = spark.createDataFrame(rows + odd, "id long, value double, grp long")
    kw = {"metric": lambda a, b: F.abs(a - b) / 10, "grid_radius": 0.2 * (1 + 1e-9)} if own else {}
    r = 0.02 if own else 0.2
    dist = (lambda a, b: abs(a - b) / 10) if own else (lambda a, b: abs(a - b))
    for keys in ([], ["grp"]):
        j = radius_join(df, df, r, include_self=False, partition_cols=keys, **kw)
        got = j.withColumn("task", F.spark_partition_id()).collect()
        points = rows if keys else [*rows, odd[1]]
        want = Counter((i, k, dist(a, b)) for i, a, g in points for k, b, h in points if i != k and dist(a, b) <= r and (not keys or g == h))
        assert Counter((x.query_id, x.neighbor_id, x.distance) for x in got) == want
        assert max(Counter(x.task for x in got).values()) < len(got) * 0.7


@pytest.mark.parametrize("k", [1, 3, 7])
def test_knn(spark, vecs, k):
    rows, df = vecs
    got = {(x.query_id, x.rank): x.neighbor_id for x in knn_join(df, df, k).collect()}
    for a, va in rows:
        order = sorted(((euclid(va, vb), b) for b, vb in rows if b != a))[:k]
        for rank, (_, b) in enumerate(order, 1):
            assert got[(a, rank)] == b


def test_knn_within_and_limits(spark, vecs):
    rows, df = vecs
    got = knn_within(df, df, 2, 1.5, include_self=False).collect()
    for x in got:
        assert x.distance <= 1.5 and x.rank <= 2
    assert knn_join(df, df, 0).count() == 0
    assert knn_within(df, df, 0, 1.0).count() == 0


def test_knn_k_larger_than_data(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "id long, value double")
    got = sorted((x.query_id, x.neighbor_id) for x in knn_join(df, df, 10).collect())
    assert got == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_rank_by_distance(spark, vecs):
    rows, df = vecs
    got = [x.neighbor_id for x in rank_by_distance(df, None, query_id=0, include_self=False).orderBy("rank").collect()]
    q = dict(rows)[0]
    assert got == [b for _, b in sorted((euclid(q, vb), b) for b, vb in rows if b != 0)]
    assert rank_by_distance(df, None, query_id=0, limit=0).count() == 0


def test_nearest_center(spark):
    pts = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 9.0), (3, 1.5)], "id long, value double")
    ctr = spark.createDataFrame([(10, 1.0), (11, 2.0)], "center_id long, value double")
    got = {x.id: x.center_id for x in nearest_center(pts, ctr, 0.5).collect()}
    assert got == {0: 10, 1: 11, 2: -1, 3: 10}  # 1.5 ties -> lowest centre id


def test_snapshot_outliers_nd(spark, vecs):
    rows, df = vecs
    got = {x.id for x in snapshot_outliers_nd(df, 1.5, 3).collect()}
    want = {a for a, va in rows if sum(1 for b, vb in rows if b != a and euclid(va, vb) <= 1.5) < 3}
    assert got == want


def test_extremes_and_sample(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 5.0), (3, 1.0), (4, 5.0)], "id long, value double")
    r = extremes(df).first()
    assert (r.min_id, r.min_value, r.max_id, r.max_value) == (1, 1.0, 2, 5.0)
    assert sample_n(df, 3, seed=1).count() == 3
    assert sample_n(df, 10).count() == 5
    assert sorted(x.id for x in sample_n(df, 3, seed=1).collect()) == \
        sorted(x.id for x in sample_n(df.repartition(3), 3, seed=1).collect())


@pytest.mark.parametrize("block_rows", [4, 16])
def test_witness_pruned_outliers_and_full_counts(spark, vecs, block_rows):
    from sparkdod.operators.search import count_neighbors, outlier_counts_nd
    rows, df = vecs
    true = {a: sum(1 for b, vb in rows if b != a and euclid(va, vb) <= 2.0) for a, va in rows}
    assert {x.id: x.neighbors for x in outlier_counts_nd(df, 2.0, 4, block_rows=block_rows).collect()} == {a: n for a, n in true.items() if n < 4}
    assert {x.id: x.neighbors for x in count_neighbors(df, 2.0, block_rows=block_rows).collect()} == true


def knn_brute(queries, data, k, dist, include_self):
    out = set()
    for q, x in queries:
        near = sorted((dist(x, y), i) for i, y in data if include_self or i != q)[:k]
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(near)}
    return out


@pytest.mark.parametrize("include_self", [True, False])
def test_knn_numbers_by_rank(spark, include_self):
    import random
    rng = random.Random(6)
    data = [(i, float(rng.choice([0, 1, 1, 1, 2, 5, 9]))) for i in range(80)] + [(200, 0.25)]
    queries = [(i, v) for i, v in data[:20]] + [(1000, 1000.0), (1001, -7.0), (1002, 1.5)]
    bad = [(500, float("nan")), (501, float("inf")), (502, None)]
    d, q = spark.createDataFrame(data + bad, "id long, value double"), spark.createDataFrame(queries + bad, "id long, value double")
    got = {(r.query_id, r.neighbor_id, r["rank"]) for r in knn_join(q, d, 4, include_self=include_self).collect()}
    assert got == knn_brute(queries, data, 4, lambda a, b: abs(a - b), include_self)


def test_knn_vectors_far_ragged_copies_and_nan(spark):
    data = [(i, [float(i % 5), float(i % 3), 0.5]) for i in range(40)] + [(50, [0.2]), (51, [0.1, 0.3])] + [(60 + i, [1.0, 1.0, 1.0]) for i in range(30)]
    queries = [(900, [50.0, 50.0, 50.0]), (901, [0.3, 0.5]), (902, [1e6]), (50, [0.2])]
    bad = [(500, [float("nan"), 1.0, 1.0]), (501, None)]
    d, q = spark.createDataFrame(data + bad, "id long, vec array<double>"), spark.createDataFrame(queries + bad, "id long, vec array<double>")
    got = {(r.query_id, r.neighbor_id, r["rank"]) for r in knn_join(q, d, 5, include_self=True, block_rows=8).collect()}
    assert got == knn_brute(queries, data, 5, euclid, True)


def test_one_row_and_empty_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<double>")
    assert [(r.id, r.neighbors) for r in snapshot_outliers_nd(one, 1.0, 1).collect()] == [(1, 0)]
    assert knn_join(one, one, 2).collect() == []
    odd = spark.createDataFrame([(1, []), (2, [3.0, 4.0]), (3, None)], "id long, vec array<double>")
    assert sorted((r.query_id, r.neighbor_id) for r in radius_join(odd, odd, 0.5, include_self=False).collect()) == [(1, 2), (2, 1)]
    got = nearest_center(odd.where("id = 2"), spark.createDataFrame([(7, [3.0, 4.5])], "center_id long, vec array<double>"), 1.0).collect()
    assert [(r.id, r.center_id, r.distance) for r in got] == [(2, 7, 0.5)]


def test_own_distance_needs_its_grid_bound(spark):
    rows = [(i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, value double")
    tenth = lambda a, b: F.abs(a - b) / 10
    with pytest.raises(ValueError):
        radius_join(df, df, 0.2, metric=tenth)
    got = radius_join(df, df, 0.2, metric=tenth, grid_radius=2.0, include_self=False)
    assert {(r.query_id, r.neighbor_id) for r in got.collect()} == {(a, b) for a, x in rows for b, y in rows if a != b and abs(x - y) / 10 <= 0.2}


def test_knn_within_keeps_partitions(spark):
    df = spark.createDataFrame([(i, float(i % 7), i % 3) for i in range(30)], "id long, value double, win int")
    got = {(r.query_id, r.neighbor_id) for r in knn_within(df, df, 2, 1.0, include_self=False, partition_cols=["win"]).collect()}
    assert got and all(a % 3 == b % 3 for a, b in got)


def test_rank_limit_plans_no_full_sort_in_one_task(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 1000)) for i in range(3000)], "id long, value double")
    got = rank_by_distance(df, 500.0, query_id=-1, limit=1500).orderBy("rank").collect()
    want = sorted((abs(i * 7 % 1000 - 500.0), i) for i in range(3000))[:1500]
    assert [(r["distance"], r.neighbor_id, r["rank"]) for r in got] == [(d, i, n + 1) for n, (d, i) in enumerate(want)]


def test_count_neighbors_1d(spark):
    from sparkdod.operators.search import count_neighbors
    vals = [0.0, 0.5, 0.5, 1.2, 7.0]
    df = spark.createDataFrame(list(enumerate(vals)), "id long, value double")
    got = {x.id: x.neighbors for x in count_neighbors(df, 0.5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 0, 4: 0}


def test_euclidean_on_int_and_float_lists(spark):
    from pyspark.sql import functions as F

    from sparkdod.functions.metrics import euclidean
    df = spark.createDataFrame([([1, 2, 3], [1.5, 2.0], [4.0, 6.0, 3.0, 9.0])],
                               "a array<int>, b array<float>, c array<double>")
    r = df.select(euclidean(F.col("a"), F.col("b")).alias("ab"), euclidean(F.col("a"), F.col("c")).alias("ac")).first()
    assert r.ab == euclid([1, 2], [1.5, 2.0]) and r.ac == euclid([1, 2, 3], [4.0, 6.0, 3.0])


@pytest.mark.parametrize("block_rows", [3, 2048])
def test_knn_hot_value_ties_by_id(spark, block_rows):
    vals = [5.0] * 30 + [1.0, 9.0, 5.2]
    df = spark.createDataFrame(list(enumerate(vals)), "id long, value double")
    got = {(x.query_id, x.rank): x.neighbor_id for x in knn_join(df, df, 3, block_rows=block_rows).collect()}
    for a, va in enumerate(vals):
        order = sorted((abs(va - vb), b) for b, vb in enumerate(vals) if b != a)[:3]
        assert [got[(a, r)] for r in (1, 2, 3)] == [b for _, b in order]


def test_row_topk_matches_full_sort_with_ties():
    import numpy as np

    from sparkdod.operators.blocks import _row_topk
    rng = np.random.default_rng(0)
    for _ in range(300):
        m, n, k = rng.integers(1, 8), rng.integers(1, 12), rng.integers(1, 6)
        mat = np.round(rng.uniform(0, 3, (m, n)), 0)
        mat[rng.uniform(size=(m, n)) < 0.3] = np.inf
        ids = rng.permutation(100)[:n].astype(np.int64)
        got = _row_topk(mat, ids, k)
        want = np.lexsort((np.broadcast_to(ids, (m, n)), mat), axis=-1)[:, :min(k, n)]
        for i in range(m):
            assert [(mat[i, j], ids[j]) for j in got[i] if np.isfinite(mat[i, j])] == \
                [(mat[i, j], ids[j]) for j in want[i] if np.isfinite(mat[i, j])]


def test_block_evaluator_exact_with_ties():
    import numpy as np
    import pandas as pd

    from sparkdod.operators.blocks import _Block, _decided, _topk_within, block_distances
    rng = np.random.default_rng(1)
    for trial in range(30):
        m, n, dims = rng.integers(1, 50), rng.integers(1, 50), int(rng.choice([1, 2, 8, 64]))
        qm = np.round(rng.normal(0, 1, (m, dims)), 1).astype(np.float32)
        dm = np.round(rng.normal(0, 1, (n, dims)), 1).astype(np.float32)
        if trial % 3 == 0:
            dm[: n // 2] = qm[0]
        qv, dv = pd.Series(list(qm)), pd.Series(list(dm))
        full = block_distances(qv, dv)
        r = float(np.quantile(full, rng.uniform(0.05, 0.9)))
        qi, dj, dist = _Block(qv, dv).within(r)
        wi, wj = np.nonzero(full <= r)
        assert sorted(zip(qi, dj, dist)) == sorted(zip(wi, wj, full[wi, wj]))
        assert (_decided(_Block(qv, dv), r, None) == (full <= r)).all()
        ids = rng.permutation(1000)[:n].astype(np.int64)
        rows, cols, dd = _topk_within(_Block(qv, dv), full <= r, ids, 3)
        for i in range(m):
            want = sorted((full[i, j], ids[j]) for j in np.nonzero(full[i] <= r)[0])[:3]
            assert [(dd[t], ids[cols[t]]) for t in np.nonzero(rows == i)[0]] == want


def test_radius_join_within_partitions(spark, vecs):
    rows, _ = vecs
    grp = {i: i % 3 for i, _ in rows}
    df = spark.createDataFrame([(i, v, grp[i]) for i, v in rows], "id long, vec array<double>, grp long")
    got = {(x.query_id, x.neighbor_id, x.grp) for x in
           radius_join(df, df, 2.5, include_self=False, partition_cols=["grp"]).collect()}
    assert got == {(a, b, grp[a]) for a, b in brute_pairs(rows, 2.5) if grp[a] == grp[b]}
    vals = [(i, float(i % 7) / 4.0, i % 2) for i in range(40)]
    d1 = spark.createDataFrame(vals, "id long, value double, grp long")
    got1 = {(x.query_id, x.neighbor_id) for x in radius_join(d1, d1, 0.3, include_self=False,
                                                             partition_cols=["grp"]).collect()}
    assert got1 == {(a, b) for a, va, ga in vals for b, vb, gb in vals
                    if a != b and ga == gb and abs(va - vb) <= 0.3}


def _close(rows, r):
    return {(i, j) for i, a in rows for j, b in rows if i != j and math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))) <= r}


@pytest.mark.parametrize("r", [0.1, 1.0, 10.0, 300.0])
def test_large_coordinates_make_few_copies(spark, r):
    """Epoch milliseconds as a coordinate: a query looks into a few cells at any radius."""
    rng = random.Random(1)
    rows = [(i, [1.7e12 + rng.random() * 1000, rng.random() * 1000]) for i in range(200)]
    rows += [(1000 + i, [rng.choice([0.0, 1e16, -1e14]) + rng.random(), 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    q, d, _ = search._axis_grid(df, df, r, "id", "vec", [], 2)
    assert q.count() <= 25 * len(rows) and d.count() <= 2 * len(rows)
    assert {(x.query_id, x.neighbor_id) for x in search.radius_join(df, df, r, include_self=False).collect()} == _close(rows, r)


@pytest.mark.parametrize("r", [0.0, 1e-6, 1e-3, 0.01])
def test_large_numbers_make_few_copies(spark, r):
    rng = random.Random(2)
    rows = [(i, 1e12 + i * 1e-4 * rng.random()) for i in range(200)] + [(1000, 1e300), (1001, 1e300), (1002, -1e300), (1003, 0.0)]
    df = spark.createDataFrame(rows, "id long, value double")
    assert df.select(F.max(F.size(grid_reach(F.col("value"), r, grid_width(r))))).first()[0] <= 5
    want = {(i, j) for i, a in rows for j, b in rows if i != j and abs(a - b) <= r}
    assert {(x.query_id, x.neighbor_id) for x in search.radius_join(df, df, r, include_self=False).collect()} == want


def test_knn_of_numbers_answers_every_row_of_a_repeated_query_id(spark):
    queries = spark.createDataFrame([(7, 1.0), (7, 100.0), (8, 1.0)], "id long, value double")
    data = spark.createDataFrame([(1, 0.0), (2, 1.5), (3, 99.0), (7, 1.0)], "id long, value double")
    got = sorted(map(tuple, knn_join(queries, data, 2).collect()))
    assert got == sorted([(7, 2, 0.5, 1), (7, 1, 1.0, 2), (7, 3, 1.0, 1), (7, 2, 98.5, 2), (8, 7, 0.0, 1), (8, 2, 0.5, 2)])
