"""FIXTURES.md section 2: the tiny window table with counts worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sparkdod.operators.cells import with_cell
from sparkdod.operators.neighbors import window_neighbor_counts
from sparkdod.operators.outliers import neighbor_profile, window_outlier_counts, window_outliers
from sparkdod.operators.windows import Windows

VALUES = [1.0, 1.2, 1.45, 5.0, 1.1, 5.4, 9.0, 1.9]
R = 0.45
W = Windows.count(8, 4)
EXPECTED_NEIGHBOURS = {1: [2, 2, 2, 0], 2: [3, 3, 4, 1, 3, 1, 0, 1], 3: [0, 0, 0, 0]}
EXPECTED_OUTLIERS = {1: {1: 1, 2: 1, 3: 4}, 2: {1: 1, 2: 4, 3: 4}, 3: {1: 4, 2: 4, 3: 4}}


@pytest.fixture(scope="module")
def pts(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "id long, value double")


@pytest.mark.parametrize("cells", [1, 3, 8])
def test_neighbour_counts_per_window(spark, pts, cells):
    prof = neighbor_profile(pts, W, R, 1, cells=cells).collect()
    got = {}
    for r in prof:
        got.setdefault(r.window_end, {})[r.id] = r.neighbors
    for e, counts in EXPECTED_NEIGHBOURS.items():
        ids = sorted(got[e])
        assert [got[e][i] for i in ids] == counts


@pytest.mark.parametrize("k", [1, 2, 3])
def test_outliers_per_window(spark, pts, k):
    got = {r.window_end: r.outliers for r in window_outlier_counts(pts, W, R, k).collect()}
    assert got == {e: EXPECTED_OUTLIERS[e][k] for e in EXPECTED_OUTLIERS}


def test_outlier_ids(spark, pts):
    rows = window_outliers(pts, W, R, 2).collect()
    assert sorted((r.window_end, r.id) for r in rows) == [(1, 3), (2, 3), (2, 5), (2, 6), (2, 7),
                                                          (3, 4), (3, 5), (3, 6), (3, 7)]


def test_cells_upper_bound_inclusive(spark, pts):
    got = [r.cell for r in with_cell(pts, "value", [1.15, 1.3, 1.6]).orderBy("id").collect()]
    assert got == [0, 1, 2, 3, 0, 3, 3, 3]


def test_cells_narrower_than_radius_do_not_lose_pairs(spark, pts):
    # bounds 1.15/1.3/1.6 make cells narrower than R: counts must not change
    c = window_neighbor_counts(pts, W, R, bounds=[1.15, 1.3, 1.6]).where(F.col("window") == 2).collect()
    by_value = {r.v: r.total - 1 for r in c}
    assert [by_value[v] for v in VALUES] == EXPECTED_NEIGHBOURS[2]
