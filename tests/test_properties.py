"""Property tests: random points, radii, thresholds and cell counts against a
brute-force double-precision self-join (SURVEY section 5.3)."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brute import neighbours, window_counts
from sparkdod.operators.neighbors import window_neighbor_counts
from sparkdod.operators.outliers import window_outlier_counts
from sparkdod.operators.windows import Windows

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

# two-decimal values put many pairs exactly at the radius (the rounding hazard)
decimal_values = st.lists(st.integers(-300, 300).map(lambda i: i / 100.0), min_size=1, max_size=60)
wide_values = st.lists(st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False), min_size=1, max_size=40)


@SETTINGS
@given(values=decimal_values, r=st.sampled_from([0.05, 0.45, 0.5, 1.0, 2.55]), cells=st.integers(1, 9))
def test_snapshot_counts_match_brute_force(spark, values, r, cells):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, value double")
    got = {row.v: row.total - 1 for row in window_neighbor_counts(df, None, r, cells=cells).collect()}
    want = neighbours(values, r)
    assert [got[v] for v in values] == want


@SETTINGS
@given(values=wide_values, r=st.floats(1e-3, 1e4), cells=st.integers(1, 5))
def test_snapshot_counts_any_magnitude(spark, values, r, cells):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, value double")
    got = {row.v: row.total - 1 for row in window_neighbor_counts(df, None, r, cells=cells).collect()}
    assert [got[v] for v in values] == neighbours(values, r)


@SETTINGS
@given(values=decimal_values, r=st.sampled_from([0.1, 0.45, 1.0]), k=st.integers(0, 6),
       slide=st.integers(1, 7), m=st.integers(1, 3), cells=st.integers(1, 4))
def test_count_windows_match_brute_force(spark, values, r, k, slide, m, cells):
    ids = list(range(len(values)))
    df = spark.createDataFrame([(i, v) for i, v in zip(ids, values)], "id long, value double")
    got = {row.window_end: row.outliers
           for row in window_outlier_counts(df, Windows.count(slide * m, slide), r, k, cells=cells).collect()}
    assert got == window_counts(ids, values, slide * m, slide, r, k)


@SETTINGS
@given(values=decimal_values, r=st.sampled_from([0.1, 0.45]), k=st.integers(1, 4),
       size=st.integers(2, 9), slide=st.integers(1, 5))
def test_slide_not_dividing_size(spark, values, r, k, size, slide):
    ids = [i * 3 - 7 for i in range(len(values))]  # gaps and negative ids
    df = spark.createDataFrame([(i, v) for i, v in zip(ids, values)], "id long, value double")
    w = Windows.count(size, slide)
    got = {row.window_end: row.outliers for row in window_outlier_counts(df, w, r, k, cells=2).collect()}
    want = window_counts(ids, values, size, slide, r, k)
    if size % slide:
        want = {e * slide + size: n for e, n in want.items()}  # labels are end ids then
    assert got == want


def test_result_does_not_depend_on_bounds(spark):
    rnd = random.Random(5)
    values = [round(rnd.gauss(0, 2), 2) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, value double")
    results = set()
    for bounds in ([], [0.0], [-0.3, -0.2, -0.1, 0.0, 0.1], [v / 10 for v in range(-40, 40, 3)]):
        rows = window_neighbor_counts(df, Windows.count(100, 50), 0.45, bounds=bounds).collect()
        results.add(tuple(sorted((r.window, r.v, r.total, r.before) for r in rows)))
    assert len(results) == 1


def test_monotone_in_radius_and_k(spark):
    rnd = random.Random(9)
    values = [round(rnd.uniform(0, 20), 2) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, value double")
    w = Windows.count(100, 50)

    def total(r, k):
        return sum(x.outliers for x in window_outlier_counts(df, w, r, k, cells=3).collect())
    assert total(0.2, 5) >= total(0.5, 5) >= total(1.0, 5)
    assert total(0.5, 2) <= total(0.5, 5) <= total(0.5, 9)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.sampled_from([0.0, 0.1, 0.2, 0.45, 0.5, 1.0, 3.0, 3.3, 7.0]), min_size=1, max_size=80),
       k=st.integers(0, 8), slide=st.integers(1, 9))
def test_dense_prune_does_not_change_results(spark, values, k, slide):
    from sparkdod.operators.outliers import window_outliers
    df = spark.createDataFrame(list(enumerate(values)), "id long, value double")
    w = Windows.count(2 * slide, slide)
    a = sorted(tuple(r) for r in window_outlier_counts(df, w, 0.45, k, prune=True).collect())
    b = sorted(tuple(r) for r in window_outlier_counts(df, w, 0.45, k, prune=False).collect())
    assert a == b
    assert dict(a) == window_counts(list(range(len(values))), values, 2 * slide, slide, 0.45, k)
    c = sorted(tuple(r) for r in window_outliers(df, w, 0.45, k, prune=True).collect())
    d = sorted(tuple(r) for r in window_outliers(df, w, 0.45, k, prune=False).collect())
    assert c == d
