"""Edge inputs (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from sparkdod.operators.cells import replicate
from sparkdod.operators.outliers import neighbor_profile, snapshot_outliers, window_outlier_counts
from sparkdod.operators.windows import Windows
from sparkdod.sources.points import parse_points, points_from_table

SCHEMA = "id long, value double"


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert window_outlier_counts(df, Windows.count(4, 2), 0.5, 1).count() == 0
    assert snapshot_outliers(df, 0.5, 1).count() == 0


def test_one_row(spark):
    df = spark.createDataFrame([(0, 1.0)], SCHEMA)
    rows = window_outlier_counts(df, Windows.count(4, 2), 0.5, 1).collect()
    assert sorted((r.window_end, r.outliers) for r in rows) == [(1, 1), (2, 1)]


def test_all_values_equal(spark):
    df = spark.createDataFrame([(i, 3.25) for i in range(50)], SCHEMA)
    prof = neighbor_profile(df, None, 0.0, 10).collect()
    assert {r.neighbors for r in prof} == {49}


def test_pair_exactly_at_radius(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.5)], SCHEMA)
    assert {r.neighbors for r in neighbor_profile(df, None, 0.5, 1).collect()} == {1}


def test_negative_values_and_gaps(spark):
    df = spark.createDataFrame([(0, -1.0), (5, -1.3), (9, 2.0), (20, -0.9)], SCHEMA)
    out = {r.id: r.neighbors for r in snapshot_outliers(df, 0.45, 5).collect()}
    assert out == {0: 2, 5: 2, 9: 0, 20: 2}


def test_slide_without_rows(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.1), (7, 1.2)], SCHEMA)
    rows = {r.window_end: r.outliers for r in window_outlier_counts(df, Windows.count(4, 2), 0.5, 1).collect()}
    # ids 0,1 -> windows 1,2 ; id 7 -> windows 4,5 ; window 3 holds no row
    assert rows == {1: 0, 2: 0, 4: 1, 5: 1}


def test_preceding_and_succeeding(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.1), (2, 1.2), (3, 1.3)], SCHEMA)
    prof = {(r.window_end, r.id): r for r in neighbor_profile(df, Windows.count(4, 2), 0.5, 2).collect()}
    r = prof[(2, 0)]
    assert (r.preceding, r.succeeding, r.neighbors, r.safe_inlier) == (1, 2, 3, True)
    r = prof[(2, 3)]
    assert (r.preceding, r.succeeding, r.neighbors, r.safe_inlier) == (3, 0, 3, False)


def test_parse_rejects(spark):
    lines = ["0&1.0", "1&1.2", "", "7", "x&1.0", "3&", "3&abc", "4&NaN", "5&inf", "6&2.5&extra"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    pts, rej = parse_points(df)
    assert sorted((r.id, r.value) for r in pts.collect()) == [(0, 1.0), (1, 1.2), (6, 2.5)]
    assert sorted(r.line for r in rej.collect()) == sorted(["", "7", "x&1.0", "3&", "3&abc", "4&NaN", "5&inf"])


def test_points_from_table_drops_bad_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (None, 4.0)], "k long, x double")
    assert sorted(r.id for r in points_from_table(df, "k", "x").collect()) == [1]


def test_replicate_reaches_all_cells_within_radius(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.3)], SCHEMA)
    rows = replicate(df, "value", [1.15, 1.3, 1.6], 0.45).collect()
    cells = {(r.id, r.cell, r.is_replica) for r in rows}
    assert cells == {(0, 0, False), (0, 1, True), (0, 2, True),
                     (1, 0, True), (1, 1, False), (1, 2, True), (1, 3, True)}


def test_time_windows_match_spark_window(spark):
    from sparkdod.operators.windows import time_windows
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts")
    ours = time_windows(df, "2 days", "1 day").select("event_id", "window_end")
    theirs = df.select("event_id", F.window("ts", "2 days", "1 day").end.alias("window_end"))
    assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0


def test_new_and_expiring_points(spark):
    from sparkdod.operators.windows import expiring, new_in_window, with_windows
    df = spark.createDataFrame([(i, float(i)) for i in range(8)], SCHEMA)
    w = Windows.count(4, 2)
    ww = with_windows(df, w)
    new = sorted((r.window, r.id) for r in new_in_window(ww, w).collect())
    old = sorted((r.window, r.id) for r in expiring(ww, w).collect())
    assert new == [(1, 0), (1, 1), (2, 2), (2, 3), (3, 4), (3, 5), (4, 6), (4, 7)]
    assert old == [(2, 0), (2, 1), (3, 2), (3, 3), (4, 4), (4, 5), (5, 6), (5, 7)]


def test_nan_and_null_values_are_not_points(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, 1.2)], SCHEMA)
    out = {r.id: r.neighbors for r in neighbor_profile(df, None, 0.5, 1).collect()}
    assert out == {0: 1, 3: 1}


def test_text_source_and_sink_round_trip(spark, tmp_path):
    from sparkdod.sources.points import read_text_points
    from sparkdod.sources.sinks import write_lines
    src = tmp_path / "in"
    src.mkdir()
    (src / "part-0.txt").write_text("0&1.0\n1&1.2\n2&9.0\nbad\n3&1.1\n")
    pts, rej = read_text_points(spark, str(src))
    assert rej.count() == 1
    counts = window_outlier_counts(pts, Windows.count(4, 2), 0.45, 1)
    write_lines(counts, str(tmp_path / "out"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["1;0", "2;1", "3;2"]  # window 3: ids 2 (9.0) and 3 (1.1), both alone


def test_command_line_job(spark, tmp_path):
    from sparkdod.job import main
    src = tmp_path / "pts.txt"
    src.write_text("0&1.0\n1&1.2\n2&9.0\n3&1.1\n")
    main(["--input", str(src), "--count-window", "4", "--count-slide", "2", "--radius", "0.45", "--k", "1",
          "--output", str(tmp_path / "out")])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1;0", "2;1", "3;2"]


def _brute_time_counts(rows, size_us, slide_us, r, k):
    """rows: (id, micros, value); windows [s, s + size) with s a multiple of slide."""
    out = {}
    for _, t, _ in rows:
        first = (t - size_us) // slide_us + 1
        for s in range(first, t // slide_us + 1):
            out.setdefault(s * slide_us + size_us, set())
    res = {}
    for end in out:
        members = [(i, v) for i, t, v in rows if end - size_us <= t < end]
        res[end] = sum(1 for i, v in members if sum(1 for j, u in members if j != i and abs(v - u) <= r) < k)
    return res


import random  # noqa: E402

import pytest  # noqa: E402


@pytest.mark.parametrize("size,slide", [("3 hours", "2 hours"), ("2 hours", "1 hour"), ("1 hour", "2 hours")])
@pytest.mark.parametrize("ltz", [True, False])
def test_time_windows_any_slide_and_timestamp_kind(spark, size, slide, ltz):
    import datetime as dt
    import random

    from sparkdod.operators.windows import to_micros
    rnd = random.Random(4)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.randrange(0, 10 * 3600 * 10**6), round(rnd.uniform(0, 3), 1)) for i in range(120)]
    ts_type = "timestamp" if ltz else "timestamp_ntz"
    df = spark.createDataFrame([(i, base + dt.timedelta(microseconds=t), v) for i, t, v in rows],
                               f"id long, ts {ts_type}, value double")
    got = {r.window_end.replace(tzinfo=None): r.outliers
           for r in window_outlier_counts(df, Windows.time(size, slide), 0.25, 3).collect()}
    epoch0 = (base - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    want = _brute_time_counts([(i, t + epoch0, v) for i, t, v in rows], to_micros(size), to_micros(slide), 0.25, 3)
    assert got == {dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=e): n for e, n in want.items()}


def test_invalid_radius_is_rejected(spark):
    from sparkdod.operators.search import radius_join
    df = spark.createDataFrame([(0, 1.0)], SCHEMA)
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            window_outlier_counts(df, Windows.count(2, 1), bad, 1)
        with pytest.raises(ValueError):
            radius_join(df, df, bad)


def test_outliers_per_cell_keeps_pruned_cells(spark):
    from sparkdod.operators.outliers import outliers_per_cell
    vals = [1.0] * 20 + [5.0, 9.0, 9.1]  # cell 0 is dense (all inliers), cells 1-2 hold outliers
    df = spark.createDataFrame(list(enumerate(vals)), SCHEMA)
    a = sorted(tuple(r) for r in outliers_per_cell(df, None, 0.45, 3, [2.0, 6.0], prune=True).collect())
    b = sorted(tuple(r) for r in outliers_per_cell(df, None, 0.45, 3, [2.0, 6.0], prune=False).collect())
    assert a == b == [(0, 0, 0), (0, 1, 1), (0, 2, 2)]


@pytest.mark.parametrize("radius, starts", [
    (60.0, [0.0, -30.0, 6e7 - 200, 1e9, -1e9, 1.7e9, 1.7e15, 60 * 2.0 ** 48 - 300, 3e18, -3e18, 1e300, -1.7e308]),
    (0.1, [200_000.0, 99_999.5, -1e9])])
def test_dense_clusters_at_any_magnitude(spark, radius, starts):
    from sparkdod.operators.clusters import cell_number as _cell, assign_clusters, dense_clusters
    rng = random.Random(7)
    vals = [s + rng.uniform(0, 8 * radius) for s in starts for _ in range(40)] + [s + radius * i for s in starts for i in range(8)]
    vals = [v for v in vals for _ in range(4)]  # every cell holds more than three points
    df = spark.createDataFrame(list(enumerate(vals)), SCHEMA)
    cells = dense_clusters(df, None, radius, 3)
    found = {r.cell: r for r in cells.collect()}
    members = {}
    for r in df.select("value", _cell(F.col("value"), radius).alias("cell")).collect():
        members.setdefault(r.cell, []).append(r.value)
    assert {c: r.points for c, r in found.items()} == {c: len(m) for c, m in members.items()}
    for c, m in members.items():
        assert max(m) - min(m) <= radius and all(abs(v - found[c].center) <= radius / 2 for v in m)
    order = sorted(members)  # a cell is one run of the sorted values
    assert all(max(members[a]) < min(members[b]) for a, b in zip(order, order[1:]))
    assert all(r.distance is not None for r in assign_clusters(df, cells, radius).collect())


def test_command_line_job_on_table_with_time_windows(spark, tmp_path, sf001):
    from sparkdod.job import main
    main(["--input", f"{sf001}/events.parquet", "--format", "parquet", "--id-col", "event_id", "--ts-col", "ts",
          "--time-window", "2 days", "--time-slide", "1 day", "--radius", "5", "--k", "10",
          "--output", str(tmp_path / "out")])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 31 and sum(int(x.split(";")[1]) for x in lines) == 1563  # FIXTURES anchor


def test_command_line_stream_plan(spark, tmp_path):
    from sparkdod.job import parse_args, stream_lines
    from sparkdod.sources.points import read_text_points
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("\n".join(f"{i}&{v}" for i, v in enumerate([1.0, 1.2, 9.0, 1.1, 5.0, 5.1])) + "\n")
    (src / "b.txt").write_text("1000&0.0\n")  # a late id closes the earlier windows
    a = parse_args(["--input", str(src), "--count-window", "4", "--count-slide", "2", "--radius", "0.45",
                    "--k", "1", "--stream"])
    points, _ = read_text_points(spark, str(src), streaming=True)
    lines = stream_lines(spark, a, points)
    assert lines.isStreaming
    q = lines.writeStream.format("memory").queryName("cli_stream").outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(r.value for r in spark.table("cli_stream").collect())
    # ids 0-3 -> windows 1, 2; ids 4-5 -> windows 3, 4 (all closed by the late id)
    assert got == ["1;0", "2;1", "3;2", "4;0"]
