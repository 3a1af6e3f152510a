"""Exact 1-D neighbour counts without enumerating pairs.

For a point ``v`` the neighbours within ``R`` form one contiguous run of the
sorted values, because ``u -> fl(u - v)`` is monotone. So the count is a
difference of two ranks::

    cnt(v) = #{u <= v + R} - #{u < v - R}

Ranks of arbitrary thresholds are computed as a distributed prefix sum:

1. duplicates are counted once per (pane, value) -> ``mult``; a value that
   holds a third of the table becomes one row;
2. data rows and *probe* rows (the thresholds ``v - R`` and ``v + R``) are
   unioned and range-partitioned by quantile cells of the key;
3. a running ``sum(mult)`` inside each (pane, cell) gives the rank inside
   the cell; an exclusive running sum over the (small) cell totals gives the
   offset of each cell;
4. ``fl(v +- R)`` can differ from the exact predicate ``abs(u - v) <= R``
   only for ``u`` within ``2**-50 * (|v| + R)`` of a threshold. Those few
   candidates are found by an equi-join on a fine slot grid (slot width
   scaled to the magnitude class of the value) and corrected with the
   exact predicate, so the counts equal a brute-force self-join bit for bit.

Every step is a shuffle on a key with bounded rows per key; nothing scales
with the square of a group. Window membership is handled by *panes*
(slides): each point probes the panes that share a window with it, and the
pane counts are added per window afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.partitioning import materialize
from .cells import ROUNDING_SLACK, quantile_bounds, with_cell
from .pane_lists import LISTED_PANES, by_span, count_lists, windows_of_lists
from .windows import Windows

_DATA, _LO, _HI = 1, 0, 2  # sort order at equal keys: lo probe < data < hi probe


def check_radius(radius: float) -> float:
    r = float(radius)
    if not (r >= 0.0) or r == float("inf"):
        raise ValueError(f"radius must be a finite number >= 0, got {radius!r}")
    return r


def _class(y: Column, r: float) -> Column:
    """Magnitude class: one class per factor 16 of ``|y| + R``."""
    return F.floor(F.log2(F.abs(y) + F.lit(r)) / F.lit(4.0)).cast("long")


def _slot_width(cls: Column) -> Column:
    # 2**(4c - 44) >= 4 * 2**-50 * (|y| + R) for every y of class c; exact power of two
    return F.pow(F.lit(2.0), cls * 4 - 44)


def distinct_values(points: DataFrame, pane: Column, value_col: str = "value") -> DataFrame:
    """(pane, value, mult): duplicates collapse before any shuffle-heavy step
    (partial aggregation happens map-side). NULL, NaN and infinite values are
    no points (D5; ``parse_points`` reports them as rejects)."""
    v = F.col(value_col).cast("double")
    return points.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) \
        .select(pane.alias("pane"), v.alias("value")) \
        .groupBy("pane", "value").agg(F.count(F.lit(1)).alias("mult"))


def pane_range_counts(d: DataFrame, radius: float, reach: int, bounds: list[float],
                      counted: str | None = None, later: bool = True) -> DataFrame:
    """For every distinct (pane ``src``, value ``v``) and every pane ``q`` with
    ``|q - src| <= reach`` (without ``later``: up to ``src``): ``cnt`` = points of pane ``q`` with
    ``abs(u - v) <= radius`` (the point itself included when ``q == src``).

    ``d`` has columns (pane, value, mult). Returns (src, v, mult, q, cnt); panes
    before the first one of ``d`` are left out, and panes behind the last one are
    not searched (they count 0).
    ``counted`` names a boolean column of ``d`` that restricts the values
    whose neighbours are counted; all of ``d`` still counts as neighbours.
    """
    r = float(radius)
    pane, v, mult = F.col("pane"), F.col("value"), F.col("mult")
    first, last, ahead = pane - reach, pane + reach if later else pane, None
    if reach > 1:  # between the first and the last pane; one aggregate over the materialised table
        lo, hi = d.agg(F.min("pane"), F.max("pane")).first()
        if lo is not None:
            first, ahead = F.greatest(first, F.lit(lo)), F.lit(hi)
    qs = F.sequence(first, last if ahead is None else F.least(last, ahead))
    is_counted = F.lit(True) if counted is None else F.coalesce(F.col(counted), F.lit(False))
    # probes (src, v, mult, q) for the values that are counted
    probes = d.where(is_counted).select(pane.alias("src"), v.alias("v"), mult, F.explode(qs).alias("q"))

    # -- 1. ranks of thresholds by a range-partitioned running sum ---------
    # one pass over the distinct table: every value yields its data row and,
    # when counted, a lo/hi probe pair for each slide it probes
    def row(q, key, kind, w, src, val, m):
        return F.struct(q.alias("q"), key.alias("key"), F.lit(kind).alias("kind"), w.alias("w"),
                        src.alias("src"), val.alias("v"), m.alias("mult"))
    nul_l, nul_d, zero = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(0).cast("long")
    data_row = F.array(row(pane, v, _DATA, mult, nul_l, nul_d, nul_l))
    probe_pairs = F.flatten(F.transform(qs, lambda q: F.array(
        row(q, v - F.lit(r), _LO, zero, pane, v, mult), row(q, v + F.lit(r), _HI, zero, pane, v, mult))))
    rows = F.when(is_counted, F.concat(data_row, probe_pairs)).otherwise(data_row)
    union = with_cell(d.select(F.explode(rows).alias("r")).select("r.*"), "key", bounds)

    in_cell = Window.partitionBy("q", "cell").orderBy("key", "kind") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = union.withColumn("run", F.sum("w").over(in_cell)).where(F.col("kind") != _DATA)

    # offsets: data totals of every non-empty (pane, cell), including cells
    # holding only probes (total 0); at most one row per (pane, cell) after
    # map-side partial sums. ``d`` is materialised, so this second read of
    # the union costs a scan of the distinct table, not of the source.
    totals = union.groupBy("q", "cell").agg(F.sum("w").alias("tot"))
    offsets = totals.select("q", "cell", (F.sum("tot").over(
        Window.partitionBy("q").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))).alias("off"))
    rank = F.col("run") + F.coalesce(F.col("off"), F.lit(0))
    # joins by sorting: sizes estimated from the source know nothing of probes, so Spark would broadcast millions of rows
    prefix = ranked.join(offsets.hint("merge"), ["q", "cell"], "left").select(
        "src", "v", "mult", "q", F.when(F.col("kind") == _HI, rank).otherwise(-rank).alias("c"))

    # -- 2. exact correction next to the two thresholds --------------------
    slack = (F.abs(F.col("v")) + F.lit(r)) * F.lit(ROUNDING_SLACK)
    x_lo, x_hi = F.col("v") - F.lit(r), F.col("v") + F.lit(r)
    g = _slot_width(_class(F.col("v"), r))

    def slot(x):
        return F.floor(x / g).cast("long")

    band_probes = probes.select(
        "src", "v", "mult", "q", _class(F.col("v"), r).alias("cls"),
        F.explode(F.array_distinct(F.array(slot(x_lo - slack), slot(x_lo + slack),
                                           slot(x_hi - slack), slot(x_hi + slack)))).alias("slot"))
    u = F.col("u")
    build = d.select(F.col("pane").alias("q"), F.col("value").alias("u"), F.col("mult").alias("um"),
                     F.explode(F.sequence(_class(F.col("value"), r) - 1, _class(F.col("value"), r) + 1)).alias("cls"))
    build = build.withColumn("slot", F.floor(u / _slot_width(F.col("cls"))).cast("long"))
    in_band = (F.abs(u - x_lo) <= slack) | (F.abs(u - x_hi) <= slack)
    counted = (u >= x_lo) & (u <= x_hi)
    exact = F.abs(u - F.col("v")) <= F.lit(r)
    corr = F.col("um") * (exact.cast("long") - counted.cast("long"))
    band = band_probes.join(build.hint("merge"), ["q", "cls", "slot"]).where(in_band) \
        .select("src", "v", "mult", "q", corr.alias("c")).where(F.col("c") != 0)

    if ahead is not None and later:
        behind = d.where(is_counted & (pane + reach > ahead)).select(
            pane.alias("src"), v.alias("v"), mult, F.explode(F.sequence(ahead + 1, pane + reach)).alias("q"), F.lit(0).cast("long").alias("c"))
        prefix = prefix.unionByName(behind)
    # one exchange by value serves this sum and the per-value windows that follow
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return prefix.unionByName(band).repartition(parts, "src", "v").groupBy("src", "v", "mult", "q").agg(F.sum("c").alias("cnt"))


# Upper target of rows (values and probes) per (slide, cell) partition of the
# running-sum window (sorted, spillable).
TARGET_ROWS_PER_CELL = 2_000_000


def choose_cells(d: DataFrame, parallelism: int, reach: int = 0) -> int:
    """Number of cells for the distinct table ``d`` (pane, value, mult): enough
    that a slide with all its probes fits ``TARGET_ROWS_PER_CELL`` per cell even
    if one slide holds all rows, and enough to give ``parallelism`` tasks when
    there are few slides. One aggregate over the materialised table."""
    import math
    n, panes = d.agg(F.count(F.lit(1)), F.approx_count_distinct("pane")).first()
    n, panes = int(n or 0), max(int(panes or 1), 1)
    by_size = math.ceil(n * (1 + 2 * (2 * reach + 1)) / TARGET_ROWS_PER_CELL)
    by_parallelism = math.ceil(parallelism / panes)
    return max(1, by_size, by_parallelism)


def union_bounds(d: DataFrame, radius: float, n_cells: int, sample_fraction: float | None = None) -> list[float]:
    """Equi-depth bounds over what the cells hold: the distinct values and both
    thresholds of each. Values closer than R leave most thresholds outside
    their own range, so bounds over the values alone would pile them up."""
    v, r = F.col("value"), F.lit(float(radius))
    return quantile_bounds(d.select(F.explode(F.array(v, v - r, v + r)).alias("key")), "key", n_cells, sample_fraction=sample_fraction)


def _bounds_for(d: DataFrame, radius: float, cells: int | None, spark_partitions: int, reach: int,
                sample_fraction: float | None) -> list[float]:
    n = choose_cells(d, spark_partitions, reach) if cells is None else cells
    return union_bounds(d, radius, n, sample_fraction)


def distinct_table(points: DataFrame, pane: Column, value_col: str = "value") -> DataFrame:
    """``distinct_values`` computed once (checkpointed): every branch of the
    count plan reads it, so the source is scanned and shuffled only once."""
    return materialize(distinct_values(points, pane, value_col))


# Dense cells: width just below R, so two members are within R even after
# rounding; only used while |value| / R < 1e6 (rounding of value / width).
DENSE_WIDTH_FACTOR = 1.0 - 1e-9
DENSE_MAX_MAGNITUDE = 1e6


def flag_undecided(d: DataFrame, radius: float, k: int, out_col: str = "__counted") -> DataFrame:
    """The distinct table with a boolean ``out_col``: False for values that are
    certain inliers, True for the rest.

    A grid cell of width just below ``R`` whose members in one slide number
    more than ``k`` (with multiplicity) makes each of them an inlier in that
    slide alone, hence in every window holding the slide: each member has at
    least ``k`` others within ``R``. Those values need no rank probes. Cell
    sizes come from a partial-aggregated count (a hot cell is one row)."""
    r = float(radius)
    v = F.col("value")
    gc = F.when(F.abs(v) < F.lit(DENSE_MAX_MAGNITUDE * r),
                F.floor(v / F.lit(r * DENSE_WIDTH_FACTOR))).cast("long")
    dc = d.withColumn("__gc", gc)
    dense = dc.groupBy("pane", "__gc").agg(F.sum("mult").alias("__n")).where(F.col("__n") > k) \
        .select("pane", "__gc", F.lit(False).alias(out_col))
    return dc.join(dense, ["pane", "__gc"], "left") \
        .withColumn(out_col, F.coalesce(F.col(out_col), F.lit(True))).drop("__gc")


def window_list(d: DataFrame, windows: Windows | None, by: Sequence = ()) -> DataFrame:
    """(window[, by...]) of all windows holding at least one point; ``by``
    are extra columns computed from the distinct table (e.g. a value cell)."""
    extra = list(by)
    if windows is None:
        return d.select(F.lit(0).cast("long").alias("window"), *extra).distinct()
    m = windows.panes_per_window
    if m is None:
        return d.select(F.col("pane").alias("window"), *extra).distinct()
    return d.select("pane", *extra).distinct().select(
        F.explode(F.sequence(F.col("pane") + 1, F.col("pane") + m)).alias("window"),
        *[F.col(c) for c in d.select(*extra).columns]).distinct()


def listed(windows: Windows | None) -> bool:
    """Windows of so many panes that a list a value replaces rank probes (``pane_lists``)."""
    return windows is not None and (windows.panes_per_window or 0) >= LISTED_PANES


def _windows_of_ranks(d: DataFrame, radius: float, m: int, bounds: list[float], flag: str | None) -> DataFrame:
    """(window, src, v, mult, total, before) by rank probes in every pane."""
    c = pane_range_counts(d, radius, m - 1, bounds, flag)
    # windows holding the point end at src+1 .. src+m, window e covers slides
    # e-m .. e-1. With running totals over the slides src-m+1 .. src+m-1 of a
    # value, a window is the difference of two: m rows per value.
    slides = Window.partitionBy("src", "v").orderBy("q")
    c = c.withColumn("run", F.sum("cnt").over(slides.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    c = c.withColumn("until", F.lag("run", m).over(slides)) \
        .withColumn("own", F.max(F.when(F.col("q") == F.col("src"), F.col("run"))).over(Window.partitionBy("src", "v")))
    until = F.coalesce("until", F.lit(0))
    return c.where(F.col("q") >= F.col("src")).select(
        (F.col("q") + 1).alias("window"), "src", "v", "mult", (F.col("run") - until).alias("total"), (F.col("own") - until).alias("before"))


def window_count_lists(d: DataFrame, radius: float, m: int, bounds_of, flag: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Counts of windows of many panes in two parts: (src, v, mult, total, before) with lists over the
    windows, and rows (window, src, v, mult, total, before) of the values in spans too large for a group (None: no value)."""
    copies, ranked = by_span(d, m, flag)
    if ranked is not None:
        ranked = materialize(ranked)
        ranked = _windows_of_ranks(ranked, radius, m, bounds_of(ranked, m - 1), "__ranked")
    return count_lists(copies, radius, m), ranked


def window_neighbor_counts(points: DataFrame, windows: Windows | None, radius: float, *,
                           value_col: str = "value", cells: int | None = None,
                           quantile_sample: float | None = None, bounds: list[float] | None = None,
                           prune_k: int | None = None, with_windows: bool = False,
                           window_keys: Sequence = ()):
    """Neighbour totals per window and distinct value.

    Returns (window, src, v, mult, total, before) where ``total`` counts the
    points of the window within ``radius`` of ``v`` (including the point
    itself and its duplicates) and ``before`` the same restricted to panes at
    or before the point's own pane (null when the slide does not divide the
    window size). ``window`` is the window number (0 without windows).
    """
    check_radius(radius)
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def bounds_of(d, reach=0):
        return bounds if bounds is not None else _bounds_for(d, radius, cells, parts, reach, quantile_sample)
    flag = "__counted" if prune_k is not None else None

    def table(pane):
        # one checkpoint: distinct values plus, when pruning, the dense flag
        d = distinct_values(points, pane, value_col)
        if prune_k is not None:
            d = flag_undecided(d, radius, prune_k, flag)
        return materialize(d)

    def done(c, d):
        return (c, window_list(d, windows, window_keys)) if with_windows else c
    if windows is None:
        d = table(F.lit(0).cast("long"))
        c = pane_range_counts(d, radius, 0, bounds_of(d), flag)
        return done(c.select(F.col("q").alias("window"), "src", "v", "mult", F.col("cnt").alias("total"),
                             F.col("cnt").alias("before")), d)
    pos = windows.position(points)
    m = windows.panes_per_window
    if m is None:
        # slide does not divide the size: every window is its own pane
        d = table(F.explode(windows.window_numbers(pos)))
        c = pane_range_counts(d, radius, 0, bounds_of(d), flag)
        return done(c.select(F.col("q").alias("window"), "src", "v", "mult", F.col("cnt").alias("total"),
                             F.lit(None).cast("long").alias("before")), d)
    d = table(windows.pane(pos))
    if listed(windows):
        lists, ranked = window_count_lists(d, radius, m, bounds_of, flag)
        c = windows_of_lists(lists)
        return done(c if ranked is None else c.unionByName(ranked), d)
    return done(_windows_of_ranks(d, radius, m, bounds_of(d, m - 1), flag), d)
