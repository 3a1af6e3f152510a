"""Windows that fire again (W5) and clusters on a stream (O4, O5), over several micro-batches."""

import datetime as dt

import pandas as pd
from test_streaming import _as_files

from sparkdod.operators.clusters import assign_in_windows, dense_clusters
from sparkdod.operators.outliers import window_outlier_counts
from sparkdod.operators.windows import Windows
from sparkdod.streaming import micro_batches as mb

DAY0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp_ntz, value double"
WINDOWS = Windows.time("2 days", "1 day")


def at(day, **more):
    return DAY0 + dt.timedelta(days=day, **more)


def counts(spark, rows, r, k):
    return {w: n for w, n in map(tuple, window_outlier_counts(spark.createDataFrame(rows, SCHEMA), WINDOWS, r, k).collect())}


def test_late_row_fires_its_windows_again(spark, tmp_path):
    """A row 1.5 s late changes windows that were emitted; one that comes after the allowed lateness changes only those still open."""
    rows = [(i, DAY0 + dt.timedelta(hours=i), float(i * 7 % 29)) for i in range(240)]
    odd = [(900, at(3, hours=1), float("nan")), (901, at(3, hours=1), None), (902, at(3, hours=1), float("inf"))]
    first = [r for r in rows if r[1] < at(5)] + [(1000, at(5, milliseconds=1300), 28.4)]  # day 5 is over by 1.3 s: its window fires
    again = (1001, at(5, milliseconds=-200), 500.0)  # 1.5 s late
    then = [r for r in rows if at(5) <= r[1] < at(7)] + [(1002, at(7, seconds=2, milliseconds=500), 3.0)]
    over = (1003, at(7, milliseconds=-200), 600.0)  # 2.7 s late: too late for the window that ends with day 7
    rest = [r for r in rows if r[1] >= at(7)]
    path = _as_files(spark, str(tmp_path), [first + odd, [again], then, [over], rest])
    run = lambda **kw: mb.run_stream_refired_counts(spark, path, "2 days", "1 day", 0.5, 3, id_col="event_id", files_per_batch=1, **kw)
    versions: dict = {}
    for w, n, v in map(tuple, run(versions=True).collect()):
        versions.setdefault(w, {})[v] = n
    plain = rows + [(1000, at(5, milliseconds=1300), 28.4), (1002, at(7, seconds=2, milliseconds=500), 3.0)]
    without, with_again = counts(spark, plain, 0.5, 3), counts(spark, [*plain, again], 0.5, 3)
    everything = counts(spark, [*plain, again, over], 0.5, 3)
    assert {w for w, v in versions.items() if len(v) > 1} == {at(5)}
    fired = [n for _, n in sorted(versions[at(5)].items())]
    assert fired == [without[at(5)], with_again[at(5)]] and fired[1] == fired[0] + 1
    # the last row counts in the window that was still open (day 8), not in the closed one (day 7)
    assert {w: n for w, n, _ in map(tuple, run().collect())} == {w: (with_again if w <= at(7) else everything)[w] for w in everything}
    assert everything[at(8)] > with_again[at(8)] and everything[at(7)] > with_again[at(7)]


def test_due_windows():
    assert mb.due_windows(None, None, 2, 10, 1, 1) == (mb.NEVER, mb.NEVER, mb.NEVER)
    assert mb.due_windows(None, 31, 2, 10, 1, 1) == (mb.NEVER, mb.NEVER, 3)
    assert mb.due_windows(31, 31, 2, 10, 1, 1) == (3, 3, 3)  # window 3 may fire again
    assert mb.due_windows(32, 45, 2, 10, 1, 1) == (4, 3, 4)  # it is over
    assert mb.due_windows(32, 45, 2, 10, 1, 25) == (1, 3, 4)


def brute_assigned(rows, r, k):
    """Each point against the dense cells of the window that ends where its slide begins."""
    from sparkdod.operators.clusters import dense_cell_width
    df = pd.DataFrame(rows, columns=["id", "ts", "value"])
    width, day = dense_cell_width(r), df["ts"].dt.floor("D")
    cell, out = (df["value"] // width).astype(int), {}
    for d in sorted(set(day)):
        inside = cell[(day < d) & (day >= d - pd.Timedelta(days=2))].value_counts()
        centers = {int(c): (c + 0.5) * width for c, n in inside.items() if n > k}
        for i, v in zip(df["id"][day == d], df["value"][day == d]):
            near = sorted((abs(v - x), c) for c, x in centers.items() if abs(v - x) <= r / 2)
            out[i] = (d.to_pydatetime(), near[0][1] if near else -1, near[0][0] if near else None)
    return out


def test_clusters_and_points_in_micro_batches(spark, tmp_path):
    rows = [(i, DAY0 + dt.timedelta(minutes=40 * i), float((i * i) % 97) / 4) for i in range(360)]
    odd = [(900, at(3, hours=1), float("nan")), (901, at(3, hours=1), None)]
    cut = at(4, seconds=1)
    one, two = [r for r in rows if r[1] <= cut], [r for r in rows if r[1] > cut]
    late = (1000, at(4, seconds=-1), 6.25)  # counts in the window that ends with day 4
    gone = (1001, at(1), 6.25)  # its slide is long over
    path = _as_files(spark, str(tmp_path), [one[:70], one[70:] + odd, [late], two[:90], two[90:] + [gone]])
    for r, k in ((2.0, 5), (0.75, 2)):
        got = mb.run_stream_assign_clusters(spark, path, "2 days", "1 day", r, k, id_col="event_id", files_per_batch=1).collect()
        want = brute_assigned([*rows, late], r, k)
        assert {x["id"]: (x["window_end"], x["cluster"], x["distance"]) for x in got} == want and len(got) == len(want)
        assert len({c for _, c, _ in want.values()}) > 3 and any(c == -1 for _, c, _ in want.values())


def test_batch_form_and_empty_tables(spark):
    rows = [(i, DAY0 + dt.timedelta(minutes=40 * i), float((i * i) % 97) / 4) for i in range(360)]
    df = spark.createDataFrame(rows, SCHEMA)
    clusters = dense_clusters(df, WINDOWS, 2.0, 5).withColumnRenamed("window_end", "window")
    points = df.selectExpr("id", "value", "date_trunc('day', ts)::timestamp_ntz AS window")
    got = {x["id"]: (x["window"], x["cluster"], x["distance"]) for x in assign_in_windows(points, clusters, 2.0).collect()}
    assert got == brute_assigned(rows, 2.0, 5)
    assert assign_in_windows(points.limit(0), clusters, 2.0).count() == 0
    alone = assign_in_windows(points, clusters.limit(0), 2.0).collect()
    assert len(alone) == 360 and all(x["cluster"] == -1 and x["distance"] is None for x in alone)


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/none")
    assert mb.run_stream_refired_counts(spark, f"{tmp_path}/none", "2 days", "1 day", 0.5, 3, id_col="event_id").count() == 0
    assert mb.run_stream_assign_clusters(spark, f"{tmp_path}/none", "2 days", "1 day", 0.5, 3, id_col="event_id").count() == 0
