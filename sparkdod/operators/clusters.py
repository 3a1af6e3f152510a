"""Dense clusters (O4, A6) and cluster assignment.

The reference grows micro-clusters in arrival order: a point with at least
``k`` undecided points within ``R/2`` founds one, members are inliers, and a
cluster with ``k`` or fewer members dissolves. That depends on arrival
order. The deterministic form used here keeps the guarantee and drops the
order: grid cells of width just below ``R``; a cell with more than ``k``
members is a dense cluster (every member has at least ``k`` others within
``R``, so none is an outlier), its centre is the cell midpoint (every
member lies within ``R/2`` of it, as in the reference).

Cells hold at any magnitude. From 1e6 radii on the width shrinks by the
rounding of a value of that size and the cell number is exact (the remainder
of DOUBLEs is); the width never grows with ``|value|``, so a number that two
widths share still spans less than ``R``. From 2^48 radii on, where DOUBLEs
lie R/32 apart or more, each distinct value is a cell and its own centre, with
the number of its bits (far above the grid's).

It is one aggregation per (window, cell) with map-side partial counts, so a
hot cell costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbors import DENSE_MAX_MAGNITUDE, DENSE_WIDTH_FACTOR, check_radius
from .search import finite, nearest_center, radius_join
from .windows import Windows


GRID_MAX_MAGNITUDE = 2.0 ** 48


def dense_cell_width(radius: float) -> float:
    return float(radius) * DENSE_WIDTH_FACTOR


def _width(size: Column, r: float) -> Column:
    """Cell width at ``|value|``: below ``R`` by at least twice the rounding of
    a value and a centre of that size; at least 3/4 ``R`` on the grid."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(size)) - 50)  # 2 to 4 times size * 2**-52
    return F.greatest(F.least(F.lit(dense_cell_width(r)), F.lit(r) - step), F.lit(r / 2 or 1.0))


def _bits(size: Column) -> Column:
    """The bits of a positive DOUBLE as a number."""
    e = F.floor(F.log2(size))
    m = size / F.pow(F.lit(2.0), e)
    e = e + F.when(m >= 2, 1).when(m < 1, -1).otherwise(0)  # log2 rounds
    return (e + 1023) * F.lit(2 ** 52) + ((size / F.pow(F.lit(2.0), e) - 1) * F.lit(2.0 ** 52)).cast("long")


def cell_number(v: Column, r: float) -> Column:
    """The grid cell of a value (LONG)."""
    size, width = F.abs(v), _width(F.abs(v), r)
    rest = v % width
    exact = F.round((v - rest) / width).cast("long") - F.when(rest < 0, 1).otherwise(0)
    alone = F.when(v == 0, 0).when(v > 0, _bits(size)).otherwise(-_bits(size))
    return F.when(size < F.lit(DENSE_MAX_MAGNITUDE * r), F.floor(v / F.lit(dense_cell_width(r) or 1.0)).cast("long")) \
        .when(size < F.lit(GRID_MAX_MAGNITUDE * r), exact).otherwise(alone).cast("long")


def cell_center(cell: Column, far: Column, r: float) -> Column:
    """Midpoint of a cell whose largest ``|value|`` is ``far``."""
    width = F.when(far < F.lit(DENSE_MAX_MAGNITUDE * r), F.lit(dense_cell_width(r))).otherwise(_width(far, r))
    return F.when(far < F.lit(GRID_MAX_MAGNITUDE * r), (cell.cast("double") + F.lit(0.5)) * width) \
        .otherwise(F.when(cell < 0, -far).otherwise(far))


def dense_clusters(points: DataFrame, windows: Windows | None, radius: float, k: int, *,
                   value_col: str = "value") -> DataFrame:
    """(window_end, cell, center, points) for every cell with more
    than ``k`` points in a window (``window_end`` is 0 without windows).

    Values that are no points (D5) are left out."""
    r = check_radius(radius)
    points = points.where(finite(value_col, False))
    v = F.col(value_col).cast("double")
    m = windows.panes_per_window if windows is not None else None
    if windows is None:
        span = F.lit(0).cast("long")
    elif m is None:
        span = F.explode(windows.window_numbers(windows.position(points)))
    else:
        span = windows.pane(windows.position(points))
    cells = points.select(span.alias("window"), cell_number(v, r).alias("cell"), F.abs(v).alias("size")) \
        .groupBy("window", "cell").agg(F.count(F.lit(1)).alias("points"), F.max("size").alias("far"))
    if m is not None:
        cells = _pane_sums(cells, m, k)
    cells = cells.where(F.col("points") > k)
    label = windows.label(F.col("window"), points) if windows is not None else F.col("window")
    return cells.select(label.alias("window_end"), "cell",
                        cell_center(F.col("cell"), F.col("far"), r).alias("center"), "points")


def _pane_sums(panes: DataFrame, m: int, k: int) -> DataFrame:
    """Windows with more than ``k`` points from the counts of panes (``window`` is the pane): a pane
    adds its points to the window that it enters and takes them off ``m`` windows later. Two
    rows for each (pane, cell), whatever ``m`` is; only rows of the result are listed window by window."""
    step = F.explode(F.array(F.struct((F.col("window") + 1).alias("window"), F.col("points").alias("change")),
                             F.struct((F.col("window") + m + 1).alias("window"), (-F.col("points")).alias("change")))).alias("s")
    steps = panes.select("cell", "far", step).select("cell", "far", "s.*").groupBy("cell", "window").agg(F.sum("change").alias("change"), F.max("far").alias("far"))
    by_cell = Window.partitionBy("cell").orderBy("window")
    run = steps.select("cell", "window", F.sum("change").over(by_cell.rowsBetween(Window.unboundedPreceding, 0)).alias("points"),
                       F.lead("window").over(by_cell).alias("next"), F.max("far").over(Window.partitionBy("cell")).alias("far"))
    return run.where(F.col("points") > k).select("cell", "points", "far", F.explode(F.sequence("window", F.col("next") - 1)).alias("window"))


def assign_clusters(points: DataFrame, clusters: DataFrame, radius: float, *, id_col: str = "id",
                    value_col: str = "value") -> DataFrame:
    """Each point's closest cluster centre within ``R/2`` (reference's
    admission rule), -1 when none. ``clusters`` has (cell, center); returns
    (id, cluster, distance)."""
    centers = clusters.select(F.col("cell").alias("center_id"), F.col("center").alias(value_col))
    out = nearest_center(points, centers, float(radius) / 2.0, id_col=id_col, value_col=value_col)
    return out.withColumnRenamed("center_id", "cluster")


def assign_in_windows(points: DataFrame, clusters: DataFrame, radius: float) -> DataFrame:
    """O5 in windows: for points ``(id, value, window)`` the closest centre within ``R/2`` among the clusters ``(window, cell, center)``
    of their own window (ties to the lowest cell), -1 if none is near: ``(id, window, cluster, distance)``."""
    centers = clusters.select("window", F.col("cell").alias("id"), F.col("center").alias("value"))
    near = radius_join(points.select("id", "value", "window"), centers, float(radius) / 2.0, partition_cols=["window"], split=False)
    best = near.groupBy("query_id", "window").agg(F.min(F.struct("distance", F.col("neighbor_id").alias("cluster"))).alias("b"))
    out = points.select("id", "window").join(best.withColumnRenamed("query_id", "id"), ["id", "window"], "left")
    return out.select("id", "window", F.coalesce("b.cluster", F.lit(-1)).cast("long").alias("cluster"), F.col("b.distance").alias("distance"))
