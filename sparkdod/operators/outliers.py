"""Distance-based outliers in sliding windows.

Definition (inclusive radius, strict threshold, the point itself excluded
by id)::

    neighbors(p, w) = #{q in w : q.id <> p.id and abs(p.value - q.value) <= R}
    outlier(p, w)   = neighbors(p, w) < k

All points with the same value in the same pane share one neighbour count,
so everything up to the per-window totals runs on distinct values; ids are
joined back only where the output lists points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.partitioning import materialize
from .cells import with_cell
from .neighbors import (check_radius, choose_cells, distinct_table, listed, pane_range_counts, union_bounds, window_count_lists,
                        window_neighbor_counts)
from .pane_lists import by_span, count_lists, windows_of_lists
from .windows import Windows


def _source_key(points: DataFrame, windows: Windows | None):
    """Column that ties a point to the ``src`` rows of the count engine: its
    slide, its window numbers (exploded) when the slide does not divide the
    window, or 0 without windows."""
    if windows is None:
        return F.lit(0).cast("long")
    pos = windows.position(points)
    if windows.panes_per_window is None:
        return F.explode(windows.window_numbers(pos))
    return windows.pane(pos)


def window_outlier_counts(points: DataFrame, windows: Windows | None, radius: float, k: int, *,
                          value_col: str = "value", cells: int | None = None, prune: bool = True) -> DataFrame:
    """O1 (flagship): ``(window_end, outliers)`` for every window that holds
    at least one point; windows without outliers report 0. ``prune`` skips
    values proven inliers by a dense cell (exact either way)."""
    c, wins = window_neighbor_counts(points, windows, radius, value_col=value_col, cells=cells,
                                     prune_k=k if prune else None, with_windows=True)
    agg = c.where(F.col("total") - 1 < k).groupBy("window").agg(F.sum("mult").cast("long").alias("outliers"))
    out = wins.join(agg, "window", "left").select("window", F.coalesce("outliers", F.lit(0)).alias("outliers"))
    label = windows.label(F.col("window"), points) if windows is not None else F.col("window")
    return out.select(label.alias("window_end"), "outliers")


def window_outliers(points: DataFrame, windows: Windows | None, radius: float, k: int, *,
                    id_col: str = "id", value_col: str = "value", cells: int | None = None,
                    prune: bool = True) -> DataFrame:
    """O2: the outlier points themselves: ``(window_end, id, value, neighbors)``.

    Only values with at most ``k`` copies can be outliers, so the outlier side
    of the final join is small per key; AQE broadcasts it when its measured
    size allows and splits hot point keys otherwise."""
    c = window_neighbor_counts(points, windows, radius, value_col=value_col, cells=cells,
                               prune_k=k if prune else None).where(F.col("total") - 1 < k)
    key = _source_key(points, windows)
    pts = points.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).cast("double").alias("value"),
                        key.alias("src"))
    out = pts.join(c, (pts.src == c.src) & (pts.value == c.v))
    if windows is not None and windows.panes_per_window is None:
        out = out.where(pts.src == c.window)
    label = windows.label(F.col("window"), points) if windows is not None else F.col("window")
    return out.select(label.alias("window_end"), "id", "value", (F.col("total") - 1).alias("neighbors"))


def snapshot_outliers(points: DataFrame, radius: float, k: int, **kw) -> DataFrame:
    """O7 for 1-D points: outliers of one set, no window: ``(id, value, neighbors)``."""
    return window_outliers(points, None, radius, k, **kw).drop("window_end")


def neighbor_profile(points: DataFrame, windows: Windows | None, radius: float, k: int, *,
                     id_col: str = "id", value_col: str = "value", cells: int | None = None) -> DataFrame:
    """O3 (A1, A2, A9): per point and window ``preceding`` (neighbours from the
    same or earlier slides: equal arrival counts as preceding), ``succeeding``
    (later slides), ``neighbors`` and ``safe_inlier`` (``succeeding >= k``:
    the point stays an inlier for the rest of its life)."""
    if windows is not None and windows.panes_per_window is None:
        raise ValueError("neighbor_profile needs a slide that divides the window size")
    key = _source_key(points, windows)
    pts = points.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).cast("double").alias("value"),
                        key.alias("src"))

    def of_points(c):  # a join by sorting: both sides grow with the points
        out = pts.join(c.hint("merge"), (pts.src == c.src) & (pts.value == c.v))
        return out.select("id", "value", *[c[n] for n in c.columns])
    if listed(windows):
        check_radius(radius)
        parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        d = distinct_table(points, windows.pane(windows.position(points)), value_col)

        def bounds_of(d, reach):
            return union_bounds(d, radius, cells if cells is not None else choose_cells(d, parts, reach))
        lists, ranked = window_count_lists(d, radius, windows.panes_per_window, bounds_of)
        out = windows_of_lists(of_points(lists), "id", "value")  # lists of the windows are joined, not a row for each
        if ranked is not None:
            out = out.unionByName(of_points(ranked))
    else:
        out = of_points(window_neighbor_counts(points, windows, radius, value_col=value_col, cells=cells))
    label = windows.label(F.col("window"), points) if windows is not None else F.col("window")
    succ = F.col("total") - F.col("before")
    return out.select(label.alias("window_end"), "id", "value",
                      (F.col("before") - 1).alias("preceding"), succ.alias("succeeding"),
                      (F.col("total") - 1).alias("neighbors"), (succ >= k).alias("safe_inlier"))


def recent_neighbors(points: DataFrame, windows: Windows, radius: float, k: int, *,
                     id_col: str = "id", value_col: str = "value", cells: int | None = None) -> DataFrame:
    """A3: per point and window, the arrival labels of its ``k`` most recent
    earlier-or-equal neighbours, newest first (the bounded ``nn_before``
    list). Arrival is the slide, so the list repeats a slide label once per
    neighbour in that slide. Built from per-slide counts: no pair is formed. A
    value has one list, the ``k`` newest of all its windows; as it runs from new to
    old, the list of a window is what lies inside it: ``m`` rows per value."""
    m = windows.panes_per_window
    if m is None:
        raise ValueError("recent_neighbors needs a slide that divides the window size")
    spark = points.sparkSession
    pos = windows.position(points)
    d = distinct_table(points, windows.pane(pos), value_col)

    def by_ranks(d, flag=None):
        n_cells = cells if cells is not None else choose_cells(d, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), m - 1)
        bounds = union_bounds(d, radius, n_cells)
        c = pane_range_counts(d, radius, m - 1, bounds, flag, later=False).where(F.col("q") <= F.col("src"))
        c = c.withColumn("others", F.least(F.col("cnt") - (F.col("q") == F.col("src")).cast("long"), F.lit(k)).cast("int"))
        per = c.groupBy("src", "v").agg(F.sort_array(F.collect_list(F.when(F.col("others") > 0, F.struct("q", "others"))), asc=False).alias("qc"))
        return per.select("src", "v", F.slice(F.flatten(F.transform("qc", lambda x: F.array_repeat(x["q"], x["others"]))), 1, k).alias("newest"))
    if listed(windows) and k > 0:
        copies, ranked = by_span(d, m)
        per = count_lists(copies, check_radius(radius), m, newest=k).select("src", "v", "newest")
        if ranked is not None:
            per = per.unionByName(by_ranks(materialize(ranked), "__ranked"))
    else:
        per = by_ranks(d)
    pts = points.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).cast("double").alias("value"),
                        windows.pane(pos).alias("src"))
    out = pts.join(per.hint("merge"), (pts.src == per.src) & (pts.value == per.v)).select(
        "id", "value", "newest", F.explode(F.sequence(per.src + 1, per.src + m)).alias("window"))
    recent = F.filter("newest", lambda q: q >= F.col("window") - m)
    labels = F.transform(recent, lambda q: windows.pane_label(q, points))
    return out.select(windows.label(F.col("window"), points).alias("window_end"), "id", "value",
                      labels.alias("preceding_ts"))


def outliers_per_cell(points: DataFrame, windows: Windows | None, radius: float, k: int, bounds, *,
                      value_col: str = "value", cells: int | None = None, prune: bool = True) -> DataFrame:
    """A4 with R1: outliers per (window, value cell); ``bounds`` ascending,
    upper bound inclusive (as the reference's partitioning). Every cell that
    owns a point of the window reports, with 0 when it has no outlier (the
    list of cells comes from the distinct values, so pruned inliers still
    keep their cell)."""
    bounds = sorted(set(float(b) for b in bounds))
    n = len(bounds)
    owner = F.lit(n).cast("long") - sum((F.col("value") <= F.lit(b)).cast("long") for b in bounds) \
        if bounds else F.lit(0).cast("long")
    c, wins = window_neighbor_counts(points, windows, radius, value_col=value_col, cells=cells,
                                     prune_k=k if prune else None, with_windows=True,
                                     window_keys=[owner.alias("cell")])
    c = with_cell(c.where(F.col("total") - 1 < k), F.col("v"), bounds, "cell")
    agg = c.groupBy("window", "cell").agg(F.sum("mult").cast("long").alias("outliers"))
    out = wins.join(agg, ["window", "cell"], "left").select(
        "window", "cell", F.coalesce("outliers", F.lit(0)).cast("long").alias("outliers"))
    label = windows.label(F.col("window"), points) if windows is not None else F.col("window")
    return out.select(label.alias("window_end"), "cell", "outliers")


def window_outlier_lines(counts: DataFrame) -> DataFrame:
    """The reference's text result ``"<window end>;<outliers>"``; the end
    is epoch milliseconds for timestamp windows, the number otherwise."""
    end = counts.schema["window_end"].dataType.typeName()
    e = F.col("window_end")
    if end == "timestamp_ntz":
        e = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), e)
    elif end == "timestamp":
        e = F.unix_millis(e)
    return counts.select(F.concat_ws(";", e.cast("string"), F.col("outliers").cast("string")).alias("line"))
