"""Stream/batch parity."""

import datetime as dt

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkdod.operators.outliers import window_outlier_counts, window_outliers
from sparkdod.operators.windows import Windows
from sparkdod.plans.catalog import events
from sparkdod.streaming import window_outliers as wo
from sparkdod.streaming.outliers import neighbour_totals, run_stream_outlier_counts

import numpy as np


def test_stream_equals_batch(spark, sf001):
    batch = window_outlier_counts(events(spark, sf001), Windows.time("2 days", "1 day"), 5.0, 3)
    stream = run_stream_outlier_counts(spark, f"{sf001}/events.parquet", "2 days", "1 day", 5.0, 3)
    b = sorted(tuple(r) for r in batch.collect())
    s = sorted(tuple(r) for r in stream.collect())
    assert s == b
    assert len(b) == 31 and sum(r[1] for r in b) == 445  # FIXTURES anchor: sf0.001, k=3


def test_neighbour_totals_exact():
    rnd = np.random.default_rng(2)
    vals = np.round(rnd.uniform(0, 5, 200), 2)
    mult = rnd.integers(1, 4, 200)
    order, tot = neighbour_totals(vals, mult, 0.45)
    x, w = vals[order], mult[order]
    want = [int(sum(w[j] for j in range(len(x)) if abs(x[j] - x[i]) <= 0.45)) for i in range(len(x))]
    assert list(tot) == want


def _as_files(spark, folder, parts):
    for n, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double").coalesce(1)
        df.write.parquet(f"{folder}/part{n}")
    import glob
    import os
    import shutil
    import time
    os.makedirs(f"{folder}/in")
    for n in range(len(parts)):
        for f in glob.glob(f"{folder}/part{n}/*.parquet"):
            shutil.copy(f, f"{folder}/in/{n}.parquet")
            os.utime(f"{folder}/in/{n}.parquet", (time.time() - 100 + n,) * 2)
    return f"{folder}/in"


def test_micro_batches_infinities_and_late_rows(spark, tmp_path):
    import datetime as dt
    day0 = dt.datetime(2024, 1, 1)
    rows = [(i, day0 + dt.timedelta(hours=i), float(i % 13)) for i in range(240)]
    odd = [(1000, day0 + dt.timedelta(hours=100), float("inf")), (1001, day0 + dt.timedelta(hours=150), float("nan"))]
    late = [(2000, day0 + dt.timedelta(hours=1), 5.0)]  # its windows have closed when the third file comes
    path = _as_files(spark, str(tmp_path), [rows[:80], rows[80:160] + odd, rows[160:] + late])
    stream = run_stream_outlier_counts(spark, path, "2 days", "1 day", 0.5, 4, files_per_batch=1)
    batch = window_outlier_counts(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double"), Windows.time("2 days", "1 day"), 0.5, 4)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


# -- outlier ids on a stream ------------------------------------------------------
def _ids(spark, rows, r, k, size="2 days", slide="1 day"):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double").withColumnRenamed("event_id", "id")
    return sorted(map(tuple, window_outliers(df, Windows.time(size, slide), r, k).collect()))


def test_stream_of_ids_equals_batch(spark, sf001):
    out = wo.run_stream_window_outliers(spark, f"{sf001}/events.parquet", "2 days", "1 day", 5.0, 3, id_col="event_id")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, window_outliers(events(spark, sf001), Windows.time("2 days", "1 day"), 5.0, 3).collect()))


def test_stream_of_ids_in_micro_batches(spark, tmp_path):
    day0 = dt.datetime(2024, 1, 1)
    rows = [(i, day0 + dt.timedelta(hours=i), float(i * 7 % 29)) for i in range(240)]
    odd = [(1000, day0 + dt.timedelta(hours=100), float("inf")), (1001, day0 + dt.timedelta(hours=150), float("nan")), (1002, day0 + dt.timedelta(hours=155), None)]
    # the second file ends 1 s into day 7; a row 1.5 s late still counts, one of a day that is over doesn't
    edge = day0 + dt.timedelta(days=7, seconds=1)
    first, rest = [r for r in rows if r[1] < edge], [r for r in rows if r[1] > edge]
    kept = (2000, edge - dt.timedelta(milliseconds=1500), 28.4)
    lost = (2001, day0 + dt.timedelta(hours=1), 28.4)  # its windows closed after the first file
    path = _as_files(spark, str(tmp_path), [first[:60], first[60:] + odd + [(1999, edge, 3.0)], [kept, lost], rest])
    for k in (1, 3, 9):
        out = wo.run_stream_window_outliers(spark, path, "2 days", "1 day", 0.5, k, id_col="event_id", files_per_batch=1)
        assert sorted(map(tuple, out.collect())) == _ids(spark, rows + [(1999, edge, 3.0), kept], 0.5, k)
    counts = wo.run_stream_window_counts(spark, path, "2 days", "1 day", 0.5, 3, id_col="event_id", files_per_batch=1)
    df = spark.createDataFrame(rows + [(1999, edge, 3.0), kept], "id long, ts timestamp_ntz, value double")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, window_outlier_counts(df, Windows.time("2 days", "1 day"), 0.5, 3).collect()))


def test_summaries_of_a_narrow_range_are_short():
    """A million values within R of each other reach the state as a few rows of k + 1 values."""
    n, k = 1_000_000, 10
    values = 5.0 + np.random.default_rng(1).random(n)
    out = wo.summaries(pd.DataFrame({"id": np.arange(n), "value": values, "t": np.full(n, 5)}), 1000, wo.cell_width(2.0), k)
    assert len(out) <= 10 and out["vals"].map(len).max() == k + 1 and out["ids"].map(len).max() == 0
    assert out[out["side"] == 0]["n"].sum() == n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from([0.0, 0.5, 0.25, 1.0, 1.5, 2.0, 7.0, 1e15, 1e15 + 0.5, -1e15, 1e300, 1e-300, 3.0000000000000004])), max_size=60),
       st.sampled_from([0.0, 0.5, 0.75, 1.0, 1e-5]), st.integers(1, 4), st.integers(1, 3))
def test_state_gives_brute_force_outliers(points, r, k, m):
    frame = lambda rows: pd.DataFrame([(i, v, p * 10 + 3) for i, (p, v) in rows], columns=["id", "value", "t"])
    rows, state, width = list(enumerate(points)), {}, wo.cell_width(r)
    for part in (rows[::2], rows[1::2]):  # two tasks
        for s in wo.summaries(frame(part), 10, width, k).itertuples(index=False):
            at, one = (s.cell, s.pane, s.side), (s.n, s.ids, s.vals)
            state[at] = wo.merge(state[at], one, s.side, k) if at in state else one
    assert all(len(x[2]) <= k + 1 for x in state.values())
    for e in range(1, 6 + m):
        inside = [(i, v) for i, (p, v) in rows if e - m <= p < e]
        want = sorted((i, v, n) for i, v in inside if (n := sum(abs(u - v) <= r for j, u in inside if j != i)) < k)
        got = []
        for cell in {c for c, _, _ in state}:
            mine = [(at[2], x) for at, x in state.items() if at[0] == cell and e - m <= at[1] < e]
            if any(side == 0 for side, _ in mine):
                got += wo.outliers_of([x for side, x in mine if side == 0], [x for side, x in mine if side], r, k)
        assert sorted(got) == want
