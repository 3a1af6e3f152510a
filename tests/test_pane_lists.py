"""Windows of many panes (lists of a span of panes) against brute force."""

import random

import pytest

from brute import count_windows
from sparkdod.operators import pane_lists
from sparkdod.operators.outliers import neighbor_profile, recent_neighbors, window_outlier_counts, window_outliers
from sparkdod.operators.windows import Windows

SLIDE, M, R, K = 5, 12, 0.45, 4
SHIFTS = [0.0, 1e9, -3e5]


def rows_of(seed):
    rnd = random.Random(seed)
    shift = SHIFTS[seed % len(SHIFTS)]
    # two decimals put pairs exactly at the radius; repeated ids, gaps, a hot value, no points
    rows = [(rnd.randrange(-60, 200), shift + (1.0 if rnd.random() < 0.2 else rnd.randint(-300, 300) / 100)) for _ in range(150)]
    return rows + [(3, None), (None, 1.0), (7, float("nan")), (8, float("inf"))]


def expected(rows):
    pts = [(i, v) for i, v in rows if i is not None and v is not None and v == v and abs(v) != float("inf")]
    out = []
    for e, members in count_windows([i for i, _ in pts], SLIDE * M, SLIDE).items():
        for p in members:
            i, v = pts[p]
            near = sorted((pts[q][0] // SLIDE for q in members if q != p and abs(pts[q][1] - v) <= R), reverse=True)
            before = [x for x in near if x <= i // SLIDE]
            out.append((e, i, v, len(before), len(near) - len(before), before[:K]))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
@pytest.mark.parametrize("group_rows", [250_000, 130, 0])
def test_lists_match_brute_force(spark, monkeypatch, seed, group_rows):
    """Whole lists, lists beside rank probes for large spans, and rank probes alone."""
    monkeypatch.setattr(pane_lists, "LISTED_ROWS", group_rows)
    monkeypatch.setattr(pane_lists, "TILE_CELLS", 100)
    df = spark.createDataFrame(rows_of(seed), "id long, value double")
    w, want = Windows.count(SLIDE * M, SLIDE), expected(rows_of(seed))
    got = [(r.window_end, r.id, r.value, r.preceding, r.succeeding) for r in neighbor_profile(df, w, R, K).collect()]
    assert sorted(got) == sorted(x[:5] for x in want)
    if seed == 0:
        got = [(r.window_end, r.id, r.value, r.preceding_ts) for r in recent_neighbors(df, w, R, K).collect()]
        assert sorted(got) == sorted((e, i, v, b) for e, i, v, _, _, b in want)
    if seed == 1:
        got = {r.window_end: r.outliers for r in window_outlier_counts(df, w, R, K).collect()}
        assert got == {e: sum(1 for x in want if x[0] == e and x[3] + x[4] < K) for e in {x[0] for x in want}}
    if seed == 2:
        got = [(r.window_end, r.id, r.value, r.neighbors) for r in window_outliers(df, w, R, K).collect()]
        assert sorted(got) == sorted((e, i, v, a + b) for e, i, v, a, b, _ in want if a + b < K)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("m", [2, 12])
def test_no_rows_that_grow_with_the_points_are_broadcast(spark, m):
    """Sizes are estimated from the source, so Spark took probes and points for small tables."""
    df = spark.range(2000).selectExpr("id", "id % 97 / 10.0d AS value")
    w = Windows.count(5 * m, 5)
    for out in (neighbor_profile(df, w, R, K), recent_neighbors(df, w, R, K)):
        assert "Broadcast" not in plan(out)


def test_a_value_is_three_rows_for_any_number_of_panes(spark):
    d = spark.range(3000).selectExpr("id div 5 AS pane", "cast(id % 97 AS double) AS value", "1L AS mult")
    for m in (8, 100):
        copies, ranked = pane_lists.by_span(d, m)
        assert ranked is None and copies.count() == 3 * 3000
