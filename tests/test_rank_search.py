"""kNN of numbers by rank: keys, repeated ids, crowded positions."""

import random

import pytest

from sparkdod.operators import ranking, search


def rows_of(seed, n):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.choice([None, float("nan"), 5.0, 5.0, rnd.randint(0, 300) / 100, rnd.randint(0, 300) / 100]),
             rnd.choice(["a", "b", "c", None])) for _ in range(n)] + [(None, 1.0, "a")]


def expected(queries, data, k, r, include_self):
    def ok(v):
        return v is not None and v == v
    found = {}
    for qi, qv, qk in queries:
        for di, dv, dk in data:
            if ok(qv) and ok(dv) and qk is not None and qk == dk and abs(qv - dv) <= r:
                if include_self or (qi is not None and di is not None and qi != di):
                    found.setdefault((qi, qk), []).append((abs(qv - dv), -1 if di is None else di))
    return sorted((str(q), key, i, d, n + 1) for (q, key), near in found.items() for n, (d, i) in enumerate(sorted(near)[:k]))


@pytest.mark.parametrize("include_self", [True, False])
@pytest.mark.parametrize("hot", [100_000, 3])
def test_within_partitions_against_brute_force(spark, monkeypatch, include_self, hot):
    monkeypatch.setattr(ranking, "HOT_QUERIES", hot)
    queries, data = rows_of(1, 80), rows_of(2, 70)
    q, d = (spark.createDataFrame(x, "id long, value double, kind string") for x in (queries, data))
    got = search.knn_within(q, d, 4, 0.45, include_self=include_self, partition_cols=["kind"])
    assert got.columns == ["query_id", "neighbor_id", "distance", "kind", "rank"]
    got = sorted((str(r.query_id), r.kind, -1 if r.neighbor_id is None else r.neighbor_id, r.distance, r["rank"]) for r in got.collect())
    assert got == expected(queries, data, 4, 0.45, include_self)


def test_partitioned_search_forms_no_pairs(spark):
    """Its joins are by position: 2 (k + 1) rows a query, and not one for every object within the radius."""
    p = spark.range(3000).selectExpr("id", "id % 10 / 100.0d AS value", "id % 2 AS kind")
    out = search.knn_within(p, p, 2, 5.0, include_self=False, partition_cols=["kind"])
    assert "__c" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 6000


def test_queries_beyond_all_objects(spark, monkeypatch):
    monkeypatch.setattr(ranking, "HOT_QUERIES", 10)
    q = spark.range(200).selectExpr("id", "1000.0d + id AS value")
    d = spark.range(50).selectExpr("id", "cast(id AS double) AS value")
    got = search.knn_join(q, d, 3, include_self=True)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((i, 49 - n, 951.0 + i + n, n + 1) for i in range(200) for n in range(3))
