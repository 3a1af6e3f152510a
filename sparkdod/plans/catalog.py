"""Registered queries: one Spark plan per operator of the inventory, each
with the DuckDB SQL that defines its result (the brute-force definition:
explode windows, self-join, count).

Every query reads whole driver tables (``events``, ``embeddings``); the
parameters below are the ones the fixtures were worked out with.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.block_metrics import chebyshev_blocks, euclidean_blocks, manhattan_blocks
from ..operators import clusters, metric_clusters, metric_search, outliers, sampling, search
from ..operators.cells import exact_bounds, replicate, with_cell
from ..operators.windows import Windows, count_based_time, expiring, new_in_window, with_windows
from ..session import scratch_path
from ..sources.points import lines_from_table, parse_points, points_from_table, read_text_points

# fixed values: workload parameters of the registered queries
R_WIN, K_WIN = 5.0, 10                 # windowed outliers (events.value)
COUNT_W, COUNT_S = 2000, 1000           # count windows (ids)
TIME_W, TIME_S = "2 days", "1 day"      # time windows
DAY_US = 86_400_000_000
R_SNAP, K_SNAP = 0.45, 50               # whole-table 1-D outliers (reference's R and k)
R_PAIRS = 0.45                          # 1-D radius pairs
R_ND, K_ND = 1.2, 5                     # embeddings
K_RECENT = 5
CELL_BOUNDS = [25.0, 50.0, 100.0]       # literal value cells for per-cell counts
SAMPLE_N, SAMPLE_SEED = 100, 42
DEPTH_CELLS = 16                        # equi-depth cells
P1_SLIDE, P1_STEP = 1000, "5 seconds"
R_WIDE, K_WIDE = 2.5, 20               # count windows, second anchor
ORD_W, ORD_S, ORD_R, ORD_K = "90 days", "30 days", 2000.0, 3   # orders.o_totalprice by o_orderdate


FINE_W, FINE_S = 4800, 100               # 48 slides per window
FINE_K = 3
RAGGED_K = 3
LIMIT = 1500
R_MANHATTAN, R_OUTLIER, R_CHEBYSHEV = 7.9, 7.2, 0.34    # embeddings
ND_W, ND_S, ND_R = 200, 50, 1.3         # vectors in windows (ids)
R_BALL, K_BALL = 2.3, 3                 # dense clusters of vectors
XY_R, XY_K = 6.0, 8                     # (value, user) of events
R_ALL = 5000.0                          # wider than all values of events


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-D points from the events stream table."""
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "value")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-D points from orders: price by order date."""
    return points_from_table(_t(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", ts_col="o_orderdate")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"),
                                                  "label")


def _round(c):
    return F.round(c, 6)


COUNT_WINDOWS = Windows.count(COUNT_W, COUNT_S)
TIME_WINDOWS = Windows.time(TIME_W, TIME_S)


# ---------------------------------------------------------------- Spark side
def q_window_outlier_counts_time(spark, sf):
    return outliers.window_outlier_counts(events(spark, sf), TIME_WINDOWS, R_WIN, K_WIN)


def q_window_outlier_counts_count(spark, sf):
    return outliers.window_outlier_counts(events(spark, sf), COUNT_WINDOWS, R_WIN, K_WIN)


def q_window_outliers_count(spark, sf):
    return outliers.window_outliers(events(spark, sf), COUNT_WINDOWS, R_WIN, K_WIN)


def q_window_outliers_time(spark, sf):
    return outliers.window_outliers(events(spark, sf), TIME_WINDOWS, R_WIN, K_WIN)


def q_outliers_per_cell(spark, sf):
    return outliers.outliers_per_cell(events(spark, sf), COUNT_WINDOWS, R_WIN, K_WIN, CELL_BOUNDS)


def q_neighbor_profile(spark, sf):
    return outliers.neighbor_profile(events(spark, sf), COUNT_WINDOWS, R_WIN, K_WIN)


def q_neighbor_profile_time(spark, sf):
    return outliers.neighbor_profile(events(spark, sf), TIME_WINDOWS, R_WIN, K_WIN)


def q_recent_neighbors(spark, sf):
    r = outliers.recent_neighbors(events(spark, sf), COUNT_WINDOWS, R_WIN, K_RECENT)
    return r.select("window_end", "id", F.array_join(F.col("preceding_ts").cast("array<string>"), ",")
                    .alias("preceding_ts"))


def q_snapshot_outliers_1d(spark, sf):
    return outliers.snapshot_outliers(events(spark, sf), R_SNAP, K_SNAP)


def q_radius_pairs(spark, sf):
    p = events(spark, sf)
    j = search.radius_join(p, p, R_PAIRS, include_self=False)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"))


def q_radius_join_nd(spark, sf):
    v = vectors(spark, sf)
    j = search.radius_join(v, v, R_ND, include_self=False)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"))


def q_snapshot_outliers_nd(spark, sf):
    return search.snapshot_outliers_nd(vectors(spark, sf), R_ND, K_ND)


def q_knn_5(spark, sf):
    v = vectors(spark, sf)
    j = search.knn_join(v, v, K_ND)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"), "rank")


def q_knn_1(spark, sf):
    v = vectors(spark, sf)
    j = search.knn_join(v, v, 1)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"))


def q_window_outlier_counts_count_wide(spark, sf):
    return outliers.window_outlier_counts(events(spark, sf), COUNT_WINDOWS, R_WIDE, K_WIDE)


def q_knn_within(spark, sf):
    v = vectors(spark, sf)
    j = search.knn_within(v, v, K_ND, R_ND, include_self=False)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"), "rank")


def q_rank_by_distance(spark, sf):
    v = vectors(spark, sf)
    j = search.rank_by_distance(v, None, query_id=0, include_self=False)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"), "rank")


def label_centroids(v: DataFrame) -> DataFrame:
    """Mean vector per label (centres derived from the table)."""
    e = v.select("label", F.posexplode("vec").alias("pos", "x"))
    m = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec")) \
        .select(F.col("label").cast("long").alias("center_id"), "vec")


def q_nearest_center(spark, sf):
    v = vectors(spark, sf)
    out = search.nearest_center(v, label_centroids(v), R_ND, vector_col="vec")
    return out.select("id", "center_id", _round(F.col("distance")).alias("distance"))


def q_dense_clusters(spark, sf):
    return clusters.dense_clusters(events(spark, sf), COUNT_WINDOWS, R_WIN, K_WIN)


def q_assign_clusters(spark, sf):
    p = events(spark, sf)
    cl = clusters.dense_clusters(p, None, R_WIN, K_WIN)
    out = clusters.assign_clusters(p, cl, R_WIN)
    return out.select("id", "cluster", _round(F.col("distance")).alias("distance"))


def _lines(spark, sf):
    e = _t(spark, sf, "events")
    line = F.when(F.col("event_type") == "error", F.concat(F.col("event_id").cast("string"), F.lit("&n/a"))) \
        .otherwise(F.concat_ws("&", F.col("event_id").cast("string"), F.col("value").cast("string")))
    return e.select(line.alias("value"))


def q_parse_points(spark, sf):
    return parse_points(_lines(spark, sf))[0]


def q_parse_rejects(spark, sf):
    return parse_points(_lines(spark, sf))[1]


def q_format_result(spark, sf):
    return outliers.window_outlier_lines(q_window_outlier_counts_time(spark, sf))


def q_extremes(spark, sf):
    return sampling.extremes(events(spark, sf))


def q_sample_n(spark, sf):
    return sampling.sample_n(events(spark, sf), SAMPLE_N, SAMPLE_SEED).select("id", "value")


def q_count_based_time(spark, sf):
    p = count_based_time(events(spark, sf).select("id", "value"), P1_SLIDE, P1_STEP)
    return p.select("id", (F.floor(F.col("id") / P1_SLIDE)).cast("long").alias("slide"), "ts")


def q_replicate_cells(spark, sf):
    p = events(spark, sf).select("id", "value")
    return replicate(p, "value", CELL_BOUNDS, R_WIN).select("id", "cell", "is_replica")


def q_value_cells(spark, sf):
    p = events(spark, sf).select("id", "value")
    return with_cell(p, "value", CELL_BOUNDS).select("id", "cell")


def q_equi_depth_cells(spark, sf):
    """Equi-depth cells: bounds by exact ranks, rows and largest value of each cell."""
    p = events(spark, sf).select("id", "value")
    return with_cell(p, "value", exact_bounds(p, "value", DEPTH_CELLS)).groupBy("cell").agg(F.count(F.lit(1)).alias("points"), F.max("value").alias("largest"))


def q_orders_window_outlier_counts(spark, sf):
    return outliers.window_outlier_counts(orders(spark, sf), Windows.time(ORD_W, ORD_S), ORD_R, ORD_K)


def q_stream_outlier_counts(spark, sf):
    from ..streaming.outliers import run_stream_outlier_counts
    return run_stream_outlier_counts(spark, os.path.join(sf, "events.parquet"), TIME_W, TIME_S, R_WIN, K_WIN)


def q_knn_two_tables(spark, sf):
    """Order prices among event values: most lie far outside them."""
    prices = points_from_table(_t(spark, sf, "orders"), "o_orderkey", "o_totalprice")
    j = search.knn_join(prices, events(spark, sf).select("id", "value"), K_ND, include_self=True)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"), F.col("rank").cast("int").alias("rank"))


def q_knn_ragged(spark, sf):
    """Queries of 1 to 64 values (by id), some far outside; distance over the shorter prefix."""
    v = vectors(spark, sf)
    x = F.transform(F.col("vec").cast("array<double>"), lambda e: e + F.when(F.col("id") % 50 == 0, 100.0).otherwise(0.0))
    q = v.select("id", F.slice(x, F.lit(1), (F.col("id") % 64 + 1).cast("int")).alias("vec"))
    j = search.knn_join(q, v.select("id", "vec"), RAGGED_K, include_self=False)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"), "rank")


def q_window_outlier_counts_fine(spark, sf):
    return outliers.window_outlier_counts(events(spark, sf), Windows.count(FINE_W, FINE_S), R_WIN, FINE_K)


def q_neighbor_profile_fine(spark, sf):
    return outliers.neighbor_profile(events(spark, sf), Windows.count(FINE_W, FINE_S), R_WIN, FINE_K)


def q_recent_neighbors_fine(spark, sf):
    r = outliers.recent_neighbors(events(spark, sf), Windows.count(FINE_W, FINE_S), R_WIN, K_RECENT)
    return r.select("window_end", "id", F.array_join(F.col("preceding_ts").cast("array<string>"), ",").alias("preceding_ts"))


def q_dense_clusters_fine(spark, sf):
    return clusters.dense_clusters(events(spark, sf), Windows.count(FINE_W, FINE_S), R_WIN, K_WIN)


def q_stream_window_outliers(spark, sf):
    """Outlier ids on a file stream."""
    from ..streaming.window_outliers import run_stream_window_outliers
    return run_stream_window_outliers(spark, os.path.join(sf, "events.parquet"), TIME_W, TIME_S, R_WIN, K_WIN, id_col="event_id")


def q_stream_window_counts(spark, sf):
    """Outlier counts on a file stream, from state that doesn't grow with the points of a value range."""
    from ..streaming.window_outliers import run_stream_window_counts
    return run_stream_window_counts(spark, os.path.join(sf, "events.parquet"), TIME_W, TIME_S, R_WIN, K_WIN, id_col="event_id")


def q_window_outlier_counts_all(spark, sf):
    """A radius above the value range: every other point is a neighbour."""
    return outliers.window_outlier_counts(events(spark, sf), COUNT_WINDOWS, R_ALL, K_WIN)


def q_rank_limit(spark, sf):
    p = events(spark, sf).select("id", "value")
    j = search.rank_by_distance(p, None, query_id=0, include_self=False, limit=LIMIT)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"), "rank")


def q_radius_join_custom_metric(spark, sf):
    """A distance of its own: a tenth of the difference."""
    p = events(spark, sf)
    j = search.radius_join(p, p, R_PAIRS / 10, metric=lambda a, b: F.abs(a - b) / 10, grid_radius=R_PAIRS * (1 + 1e-9), include_self=False)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"))


def q_knn_within_partitioned(spark, sf):
    """Nearest events of the same type."""
    p = _t(spark, sf, "events").select(F.col("event_id").alias("id"), "value", "event_type")
    j = search.knn_within(p, p, K_ND, R_PAIRS, include_self=False, partition_cols=["event_type"])
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"), "rank", "event_type")


def q_knn_manhattan(spark, sf):
    v = vectors(spark, sf)
    j = metric_search.metric_knn(v, v, K_ND, metric=manhattan_blocks)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"), "rank")


def q_knn_text_ids(spark, sf):
    v = vectors(spark, sf).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), "vec")
    j = metric_search.metric_knn(v, v, K_ND, metric=euclidean_blocks)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"), "rank")


def q_knn_int_vectors(spark, sf):
    """Lists of integers; many equal distances, ordered by id."""
    v = vectors(spark, sf).select("id", F.transform("vec", lambda x: F.floor(x.cast("double") * 10).cast("int")).alias("vec"))
    j = search.knn_join(v, v, K_ND)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"), "rank")


def q_knn_within_chebyshev(spark, sf):
    v = vectors(spark, sf)
    j = metric_search.metric_knn(v, v, K_ND, metric=chebyshev_blocks, radius=R_CHEBYSHEV)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"), "rank")


def q_radius_join_manhattan(spark, sf):
    v = vectors(spark, sf)
    j = metric_search.metric_radius_join(v, v, R_MANHATTAN, metric=manhattan_blocks, include_self=False)
    return j.select("query_id", "neighbor_id", _round(F.col("distance")).alias("distance"))


def q_nearest_center_manhattan(spark, sf):
    v = vectors(spark, sf)
    out = metric_search.metric_nearest_center(v, label_centroids(v), R_MANHATTAN, metric=manhattan_blocks)
    return out.select("id", F.coalesce("center_id", F.lit(-1)).cast("long").alias("center_id"), _round(F.col("distance")).alias("distance"))


def q_outliers_manhattan(spark, sf):
    return metric_search.metric_outliers(vectors(spark, sf), R_OUTLIER, K_ND, metric=manhattan_blocks)


def q_window_outlier_counts_nd(spark, sf):
    return metric_search.window_outlier_counts_nd(vectors(spark, sf), Windows.count(ND_W, ND_S), ND_R, K_ND)


def q_neighbor_profile_nd(spark, sf):
    return metric_search.neighbor_profile_nd(vectors(spark, sf), Windows.count(ND_W, ND_S), ND_R, K_ND)


def q_window_outliers_xy(spark, sf):
    """Events as (value, user) in time windows, the larger difference as distance."""
    xy = _t(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.array("value", F.col("user_id").cast("double")).alias("vec"))
    return metric_search.window_outliers_nd(xy, TIME_WINDOWS, XY_R, XY_K, metric=chebyshev_blocks)


def q_stream_refired_counts(spark, sf):
    """Outlier counts on a file stream whose windows fire again for late rows; the last version of each."""
    from ..streaming.micro_batches import run_stream_refired_counts
    return run_stream_refired_counts(spark, os.path.join(sf, "events.parquet"), TIME_W, TIME_S, R_WIN, K_WIN, id_col="event_id").drop("version")


def q_stream_assign_clusters(spark, sf):
    """Points of a file stream and the clusters of the window before their slide."""
    from ..streaming.micro_batches import run_stream_assign_clusters
    out = run_stream_assign_clusters(spark, os.path.join(sf, "events.parquet"), TIME_W, TIME_S, R_WIN, K_WIN, id_col="event_id")
    return out.withColumn("distance", _round(F.col("distance")))


def q_dense_clusters_nd(spark, sf):
    return metric_clusters.dense_clusters_nd(vectors(spark, sf), Windows.count(ND_W, ND_S), R_BALL, K_BALL)


def q_assign_clusters_nd(spark, sf):
    out = metric_clusters.assign_clusters_nd(vectors(spark, sf), None, R_BALL, K_BALL)
    return out.select("id", F.coalesce("center_id", F.lit(-1)).cast("long").alias("center_id"), _round(F.col("distance")).alias("distance"))


def q_text_points(spark, sf):
    """The table written as ``id&value`` lines and read back."""
    path = scratch_path(spark, "text-points")
    lines_from_table(_t(spark, sf, "events"), "event_id", "value").write.text(path)
    return read_text_points(spark, path)[0]


def q_new_in_window(spark, sf):
    return new_in_window(with_windows(events(spark, sf), COUNT_WINDOWS), COUNT_WINDOWS).select("window", "id")


def q_expiring(spark, sf):
    return expiring(with_windows(events(spark, sf), COUNT_WINDOWS), COUNT_WINDOWS).select("window", "id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "window_outlier_counts_time": q_window_outlier_counts_time,
    "window_outlier_counts_count": q_window_outlier_counts_count,
    "window_outliers_count": q_window_outliers_count,
    "window_outliers_time": q_window_outliers_time,
    "outliers_per_cell": q_outliers_per_cell,
    "neighbor_profile": q_neighbor_profile,
    "neighbor_profile_time": q_neighbor_profile_time,
    "recent_neighbors": q_recent_neighbors,
    "snapshot_outliers_1d": q_snapshot_outliers_1d,
    "radius_pairs": q_radius_pairs,
    "radius_join_nd": q_radius_join_nd,
    "snapshot_outliers_nd": q_snapshot_outliers_nd,
    "knn_5": q_knn_5,
    "knn_1": q_knn_1,
    "window_outlier_counts_count_wide": q_window_outlier_counts_count_wide,
    "knn_within": q_knn_within,
    "rank_by_distance": q_rank_by_distance,
    "nearest_center": q_nearest_center,
    "dense_clusters": q_dense_clusters,
    "assign_clusters": q_assign_clusters,
    "parse_points": q_parse_points,
    "parse_rejects": q_parse_rejects,
    "format_result": q_format_result,
    "extremes": q_extremes,
    "sample_n": q_sample_n,
    "count_based_time": q_count_based_time,
    "replicate_cells": q_replicate_cells,
    "value_cells": q_value_cells,
    "equi_depth_cells": q_equi_depth_cells,
    "orders_window_outlier_counts": q_orders_window_outlier_counts,
    "stream_outlier_counts": q_stream_outlier_counts,
    "knn_two_tables": q_knn_two_tables,
    "knn_ragged": q_knn_ragged,
    "window_outlier_counts_fine": q_window_outlier_counts_fine,
    "neighbor_profile_fine": q_neighbor_profile_fine,
    "window_outlier_counts_all": q_window_outlier_counts_all,
    "rank_limit": q_rank_limit,
    "radius_join_custom_metric": q_radius_join_custom_metric,
    "knn_within_partitioned": q_knn_within_partitioned,
    "text_points": q_text_points,
    "recent_neighbors_fine": q_recent_neighbors_fine,
    "dense_clusters_fine": q_dense_clusters_fine,
    "stream_window_outliers": q_stream_window_outliers,
    "stream_window_counts": q_stream_window_counts,
    "new_in_window": q_new_in_window,
    "expiring": q_expiring,
    "knn_manhattan": q_knn_manhattan,
    "knn_text_ids": q_knn_text_ids,
    "knn_int_vectors": q_knn_int_vectors,
    "knn_within_chebyshev": q_knn_within_chebyshev,
    "radius_join_manhattan": q_radius_join_manhattan,
    "nearest_center_manhattan": q_nearest_center_manhattan,
    "outliers_manhattan": q_outliers_manhattan,
    "window_outlier_counts_nd": q_window_outlier_counts_nd,
    "neighbor_profile_nd": q_neighbor_profile_nd,
    "window_outliers_xy": q_window_outliers_xy,
    "stream_refired_counts": q_stream_refired_counts,
    "stream_assign_clusters": q_stream_assign_clusters,
    "dense_clusters_nd": q_dense_clusters_nd,
    "assign_clusters_nd": q_assign_clusters_nd,
}


# ---------------------------------------------------------------- oracle side
def _d(x: float) -> str:
    """A DOUBLE literal (a bare decimal would be DECIMAL in DuckDB)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


_WIN_OUT_MS = "epoch_ms(window_end)"

# points with count-window panes exploded to their two windows (end numbers)
_COUNT_WIN = f"""
  p AS (SELECT event_id AS id, value, event_id // {COUNT_S} AS pane FROM events),
  w AS (SELECT id, value, pane + j AS e, pane FROM p, range(1, {COUNT_W // COUNT_S + 1}) t(j))"""
_TIME_WIN = f"""
  p AS (SELECT event_id AS id, value, epoch_us(ts) // {DAY_US} AS pane FROM events),
  w AS (SELECT id, value, pane + j AS e, pane FROM p, range(1, 3) t(j))"""


def _nb(r: float) -> str:
    """Left self-join inside windows: neighbour count per (window, point)."""
    return f"""
  nb AS (SELECT a.e, a.id, a.value, a.pane, count(b.id) AS nb,
                count(b.id) FILTER (WHERE b.pane <= a.pane) AS prec
         FROM w a LEFT JOIN w b
           ON a.e = b.e AND a.id <> b.id
          AND b.value BETWEEN a.value - {r + 1.0} AND a.value + {r + 1.0}
          AND abs(a.value - b.value) <= {_d(r)}
         GROUP BY a.e, a.id, a.value, a.pane)"""


def _pairs_1d(r: float) -> str:
    return f"""SELECT a.event_id AS query_id, b.event_id AS neighbor_id, abs(a.value - b.value) AS distance
  FROM events a JOIN events b
    ON a.event_id <> b.event_id AND b.value BETWEEN a.value - {r + 1.0} AND a.value + {r + 1.0}
   AND abs(a.value - b.value) <= {_d(r)}"""


_VEC_DIST = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_PAIRS_ND = f"""SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, {_VEC_DIST} AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"""

# the definitions' own constants, not those of the code under test
_W_DENSE = 5.0 * (1.0 - 1e-9)
_SLACK = 2.0 ** -50

ORACLE: dict[str, str] = {
    "window_outlier_counts_time": f"""WITH {_TIME_WIN}, {_nb(R_WIN)}
SELECT make_timestamp(e * {DAY_US}) AS window_end, sum(CASE WHEN nb < {K_WIN} THEN 1 ELSE 0 END)::BIGINT AS outliers
FROM nb GROUP BY e""",
    "window_outlier_counts_count": f"""WITH {_COUNT_WIN}, {_nb(R_WIN)}
SELECT e AS window_end, sum(CASE WHEN nb < {K_WIN} THEN 1 ELSE 0 END)::BIGINT AS outliers FROM nb GROUP BY e""",
    "window_outliers_count": f"""WITH {_COUNT_WIN}, {_nb(R_WIN)}
SELECT e AS window_end, id, value, nb AS neighbors FROM nb WHERE nb < {K_WIN}""",
    "window_outliers_time": f"""WITH {_TIME_WIN}, {_nb(R_WIN)}
SELECT make_timestamp(e * {DAY_US}) AS window_end, id, value, nb AS neighbors FROM nb WHERE nb < {K_WIN}""",
    "outliers_per_cell": f"""WITH {_COUNT_WIN}, {_nb(R_WIN)}
SELECT e AS window_end,
       ((value > {_d(CELL_BOUNDS[0])})::INT + (value > {_d(CELL_BOUNDS[1])})::INT
        + (value > {_d(CELL_BOUNDS[2])})::INT)::BIGINT AS cell,
       sum(CASE WHEN nb < {K_WIN} THEN 1 ELSE 0 END)::BIGINT AS outliers
FROM nb GROUP BY ALL""",
    "neighbor_profile": f"""WITH {_COUNT_WIN}, {_nb(R_WIN)}
SELECT e AS window_end, id, value, prec AS preceding, nb - prec AS succeeding, nb AS neighbors,
       (nb - prec) >= {K_WIN} AS safe_inlier FROM nb""",
    "recent_neighbors": f"""WITH {_COUNT_WIN},
  pr AS (SELECT a.e, a.id, b.pane AS bp
         FROM w a JOIN w b
           ON a.e = b.e AND a.id <> b.id AND b.pane <= a.pane
          AND b.value BETWEEN a.value - {R_WIN + 1.0} AND a.value + {R_WIN + 1.0}
          AND abs(a.value - b.value) <= {_d(R_WIN)}),
  rk AS (SELECT e, id, bp, row_number() OVER (PARTITION BY e, id ORDER BY bp DESC) AS rn FROM pr),
  ls AS (SELECT e, id, array_to_string(list(bp::VARCHAR ORDER BY rn), ',') AS s FROM rk WHERE rn <= {K_RECENT}
         GROUP BY e, id)
SELECT w.e AS window_end, w.id, coalesce(ls.s, '') AS preceding_ts FROM w LEFT JOIN ls ON w.e = ls.e AND w.id = ls.id""",
    # inner range join + equality outer join: DuckDB's outer range join
    # dropped some zero-neighbour rows on whole tables
    "snapshot_outliers_1d": f"""WITH nb AS (SELECT query_id AS id, count(*) AS n FROM ({_pairs_1d(R_SNAP)}) GROUP BY query_id)
SELECT e.event_id AS id, e.value, coalesce(nb.n, 0) AS neighbors
FROM events e LEFT JOIN nb ON e.event_id = nb.id WHERE coalesce(nb.n, 0) < {K_SNAP}""",
    "radius_pairs": f"""SELECT query_id, neighbor_id, round(distance, 6) AS distance FROM ({_pairs_1d(R_PAIRS)})""",
    "radius_join_nd": f"""SELECT query_id, neighbor_id, round(distance, 6) AS distance FROM ({_PAIRS_ND})
WHERE distance <= {_d(R_ND)}""",
    "snapshot_outliers_nd": f"""SELECT a.vec_id AS id, count(b.vec_id) AS neighbors
FROM embeddings a LEFT JOIN embeddings b ON a.vec_id <> b.vec_id AND {_VEC_DIST} <= {_d(R_ND)}
GROUP BY a.vec_id HAVING count(b.vec_id) < {K_ND}""",
    "knn_5": f"""SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM ({_PAIRS_ND}))
WHERE rank <= {K_ND}""",
    "knn_within": f"""SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM ({_PAIRS_ND})
  WHERE distance <= {_d(R_ND)})
WHERE rank <= {K_ND}""",
    "rank_by_distance": f"""SELECT 0::BIGINT AS query_id, neighbor_id, round(distance, 6) AS distance,
       (row_number() OVER (ORDER BY distance, neighbor_id))::BIGINT AS rank
FROM ({_PAIRS_ND}) WHERE query_id = 0""",
    "nearest_center": f"""WITH e AS (SELECT label, pos, avg(x::DOUBLE) AS x
           FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
           GROUP BY label, pos),
  c AS (SELECT label::BIGINT AS center_id, list(x ORDER BY pos) AS vec FROM e GROUP BY label),
  d AS (SELECT a.vec_id AS id, c.center_id, list_distance(a.embedding::DOUBLE[], c.vec) AS distance
        FROM embeddings a, c),
  best AS (SELECT id, arg_min(center_id, (distance, center_id)) AS center_id, min(distance) AS distance
           FROM d WHERE distance <= {_d(R_ND)} GROUP BY id)
SELECT a.vec_id AS id, coalesce(best.center_id, -1)::BIGINT AS center_id, round(best.distance, 6) AS distance
FROM embeddings a LEFT JOIN best ON a.vec_id = best.id""",
    "dense_clusters": f"""WITH {_COUNT_WIN}
SELECT e AS window_end, floor(value / {_d(_W_DENSE)})::BIGINT AS cell,
       (floor(value / {_d(_W_DENSE)})::BIGINT::DOUBLE + 0.5::DOUBLE) * {_d(_W_DENSE)} AS center,
       count(*) AS points
FROM w GROUP BY ALL HAVING count(*) > {K_WIN}""",
    "assign_clusters": f"""WITH c AS (SELECT floor(value / {_d(_W_DENSE)})::BIGINT AS cell FROM events GROUP BY 1
           HAVING count(*) > {K_WIN}),
  cc AS (SELECT cell, (cell::DOUBLE + 0.5::DOUBLE) * {_d(_W_DENSE)} AS center FROM c),
  d AS (SELECT e.event_id AS id, cc.cell, abs(e.value - cc.center) AS distance FROM events e JOIN cc
          ON cc.center BETWEEN e.value - {R_WIN} AND e.value + {R_WIN}
         AND abs(e.value - cc.center) <= {_d(R_WIN / 2.0)}),
  best AS (SELECT id, arg_min(cell, (distance, cell)) AS cell, min(distance) AS distance FROM d GROUP BY id)
SELECT e.event_id AS id, coalesce(best.cell, -1)::BIGINT AS cluster, round(best.distance, 6) AS distance
FROM events e LEFT JOIN best ON e.event_id = best.id""",
    "parse_points": "SELECT event_id AS id, value FROM events WHERE event_type <> 'error'",
    "parse_rejects": "SELECT event_id::VARCHAR || '&n/a' AS line FROM events WHERE event_type = 'error'",
    "format_result": f"""WITH {_TIME_WIN}, {_nb(R_WIN)}
SELECT (epoch_ms(make_timestamp(e * {DAY_US})))::VARCHAR || ';'
       || (sum(CASE WHEN nb < {K_WIN} THEN 1 ELSE 0 END)::BIGINT)::VARCHAR AS line FROM nb GROUP BY e""",
    "extremes": """SELECT arg_min(event_id, (value, event_id)) AS min_id, min(value) AS min_value,
       arg_max(event_id, (value, -event_id)) AS max_id, max(value) AS max_value FROM events""",
    "count_based_time": f"""SELECT event_id AS id, event_id // {P1_SLIDE} AS slide,
       make_timestamp((event_id // {P1_SLIDE}) * 5000000) AS ts FROM events""",
    "replicate_cells": f"""WITH p AS (SELECT event_id AS id, value,
       (abs(value) + {_d(R_WIN)}) * {_d(_SLACK)} AS s FROM events),
  c AS (SELECT id,
      ((value > {_d(CELL_BOUNDS[0])})::INT + (value > {_d(CELL_BOUNDS[1])})::INT + (value > {_d(CELL_BOUNDS[2])})::INT) AS own,
      ((value - {_d(R_WIN)} - s > {_d(CELL_BOUNDS[0])})::INT + (value - {_d(R_WIN)} - s > {_d(CELL_BOUNDS[1])})::INT
        + (value - {_d(R_WIN)} - s > {_d(CELL_BOUNDS[2])})::INT) AS lo,
      ((value + {_d(R_WIN)} + s > {_d(CELL_BOUNDS[0])})::INT + (value + {_d(R_WIN)} + s > {_d(CELL_BOUNDS[1])})::INT
        + (value + {_d(R_WIN)} + s > {_d(CELL_BOUNDS[2])})::INT) AS hi FROM p)
SELECT id, cell::BIGINT AS cell, cell <> own AS is_replica FROM c, range(lo, hi + 1) t(cell)""",
    "value_cells": f"""SELECT event_id AS id,
  ((value > {_d(CELL_BOUNDS[0])})::INT + (value > {_d(CELL_BOUNDS[1])})::INT + (value > {_d(CELL_BOUNDS[2])})::INT)::BIGINT AS cell
FROM events""",
}
_ORD_US = 30 * DAY_US
ORACLE["orders_window_outlier_counts"] = f"""WITH
  p AS (SELECT o_orderkey AS id, o_totalprice AS value, epoch_us(o_orderdate) // {_ORD_US} AS pane FROM orders),
  w AS (SELECT id, value, pane + j AS e, pane FROM p, range(1, 4) t(j)),
  nb AS (SELECT a.e, a.id, count(b.id) AS nb FROM w a LEFT JOIN w b
           ON a.e = b.e AND a.id <> b.id
          AND b.value BETWEEN a.value - {ORD_R + 1.0} AND a.value + {ORD_R + 1.0}
          AND abs(a.value - b.value) <= {_d(ORD_R)}
         GROUP BY a.e, a.id)
SELECT make_timestamp(e * {_ORD_US}) AS window_end, sum(CASE WHEN nb < {ORD_K} THEN 1 ELSE 0 END)::BIGINT AS outliers
FROM nb GROUP BY e"""
ORACLE["knn_1"] = f"""SELECT query_id, neighbor_id, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM ({_PAIRS_ND}))
WHERE rank = 1"""
ORACLE["window_outlier_counts_count_wide"] = f"""WITH {_COUNT_WIN}, {_nb(R_WIDE)}
SELECT e AS window_end, sum(CASE WHEN nb < {K_WIDE} THEN 1 ELSE 0 END)::BIGINT AS outliers FROM nb GROUP BY e"""
ORACLE["neighbor_profile_time"] = f"""WITH {_TIME_WIN}, {_nb(R_WIN)}
SELECT make_timestamp(e * {DAY_US}) AS window_end, id, value, prec AS preceding, nb - prec AS succeeding,
       nb AS neighbors, (nb - prec) >= {K_WIN} AS safe_inlier FROM nb"""
# the streaming form must give the batch result
ORACLE["stream_outlier_counts"] = ORACLE["window_outlier_counts_time"]
ORACLE["knn_two_tables"] = f"""WITH v AS (SELECT event_id AS id, value, row_number() OVER (ORDER BY value, event_id) AS up,
         row_number() OVER (ORDER BY value DESC, event_id) AS down FROM events),
  q AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE AS x FROM orders),
  b AS (SELECT q.id, q.x, (SELECT count(*) FROM events) AS n, coalesce(s.c, 0) AS c
        FROM q ASOF LEFT JOIN (SELECT value, max(up) AS c FROM v GROUP BY value) s ON q.x > s.value),
  p AS (SELECT b.id AS query_id, v.id AS neighbor_id, abs(b.x - v.value) AS distance FROM b, range(1, {K_ND + 1}) t(j), v WHERE v.up = b.c + j
        UNION ALL SELECT b.id, v.id, abs(b.x - v.value) FROM b, range(1, {K_ND + 1}) t(j), v WHERE v.down = b.n - b.c + j)
SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p) WHERE rank <= {K_ND}"""
ORACLE["knn_ragged"] = f"""WITH q AS (SELECT vec_id AS id, list_transform(embedding[1:vec_id % 64 + 1], lambda x: x::DOUBLE + CASE WHEN vec_id % 50 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS x FROM embeddings),
  p AS (SELECT q.id AS query_id, e.vec_id AS neighbor_id, list_distance(q.x[1:least(len(q.x), len(e.embedding))], e.embedding[1:least(len(q.x), len(e.embedding))]::DOUBLE[]) AS distance
        FROM q JOIN embeddings e ON q.id <> e.vec_id)
SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p) WHERE rank <= {RAGGED_K}"""
# neighbours per (window, point) from per-slide counts of pairs, each pair formed once
_FINE = f"""
  p AS (SELECT event_id AS id, value, event_id // {FINE_S} AS pane FROM events),
  w AS (SELECT id, value, pane + j AS e, pane FROM p, range(1, {FINE_W // FINE_S + 1}) t(j)),
  s AS (SELECT a.id, a.pane, b.pane AS q, count(*) AS c FROM p a JOIN p b
          ON a.id <> b.id AND b.value BETWEEN a.value - {R_WIN + 1.0} AND a.value + {R_WIN + 1.0}
         AND abs(a.value - b.value) <= {_d(R_WIN)} AND abs(a.pane - b.pane) < {FINE_W // FINE_S}
         GROUP BY ALL),
  n AS (SELECT id, greatest(pane, q) + j AS e, sum(c) AS nb, sum(CASE WHEN q <= pane THEN c ELSE 0 END) AS prec
        FROM s, range(1, {FINE_W // FINE_S + 1}) t(j) WHERE greatest(pane, q) + j <= least(pane, q) + {FINE_W // FINE_S} GROUP BY ALL),
  nb AS (SELECT w.e, w.id, w.value, coalesce(n.nb, 0)::BIGINT AS nb, coalesce(n.prec, 0)::BIGINT AS prec
         FROM w LEFT JOIN n ON w.id = n.id AND w.e = n.e)"""
ORACLE["window_outlier_counts_fine"] = f"""WITH {_FINE}
SELECT e AS window_end, sum(CASE WHEN nb < {FINE_K} THEN 1 ELSE 0 END)::BIGINT AS outliers FROM nb GROUP BY e"""
ORACLE["neighbor_profile_fine"] = f"""WITH {_FINE}
SELECT e AS window_end, id, value, prec AS preceding, nb - prec AS succeeding, nb AS neighbors,
       (nb - prec) >= {FINE_K} AS safe_inlier FROM nb"""
ORACLE["recent_neighbors_fine"] = f"""WITH {_FINE},
  newest AS (SELECT id, q, row_number() OVER (PARTITION BY id ORDER BY q DESC) AS rn
             FROM (SELECT id, q, unnest(range(least(c, {K_RECENT}))) FROM s WHERE q <= pane))
SELECT w.e AS window_end, w.id, coalesce(string_agg(t.q::VARCHAR, ',' ORDER BY t.rn), '') AS preceding_ts
FROM w LEFT JOIN newest t ON w.id = t.id AND t.rn <= {K_RECENT} AND t.q >= w.e - {FINE_W // FINE_S} GROUP BY w.e, w.id"""
ORACLE["dense_clusters_fine"] = f"""WITH w AS (SELECT value, event_id // {FINE_S} + j AS e FROM events, range(1, {FINE_W // FINE_S + 1}) t(j))
SELECT e AS window_end, floor(value / {_d(_W_DENSE)})::BIGINT AS cell,
       (floor(value / {_d(_W_DENSE)})::BIGINT::DOUBLE + 0.5::DOUBLE) * {_d(_W_DENSE)} AS center, count(*) AS points
FROM w GROUP BY ALL HAVING count(*) > {K_WIN}"""
ORACLE["stream_window_outliers"] = ORACLE["window_outliers_time"]
ORACLE["stream_window_counts"] = ORACLE["window_outlier_counts_time"]
ORACLE["equi_depth_cells"] = f"""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events),
  b AS (SELECT DISTINCT value AS bound FROM r JOIN range(1, {DEPTH_CELLS}) t(i) ON r.r = (i * n + {DEPTH_CELLS - 1}) // {DEPTH_CELLS}),
  c AS (SELECT value, (SELECT count(*) FROM b WHERE bound < e.value) AS cell FROM events e)
SELECT cell, count(*) AS points, max(value) AS largest FROM c GROUP BY cell"""
ORACLE["stream_refired_counts"] = ORACLE["window_outlier_counts_time"]
ORACLE["stream_assign_clusters"] = f"""WITH {_TIME_WIN},
  c AS (SELECT e, floor(value / {_d(_W_DENSE)})::BIGINT AS cell FROM w GROUP BY ALL HAVING count(*) > {K_WIN}),
  cc AS (SELECT e, cell, (cell::DOUBLE + 0.5::DOUBLE) * {_d(_W_DENSE)} AS center FROM c),
  best AS (SELECT id, arg_min(cell, (distance, cell)) AS cell, min(distance) AS distance FROM (
    SELECT p.id, cc.cell, abs(p.value - cc.center) AS distance FROM p JOIN cc ON cc.e = p.pane AND abs(p.value - cc.center) <= {_d(R_WIN / 2.0)}) GROUP BY id)
SELECT p.id, make_timestamp(pane * {DAY_US}) AS window_end, coalesce(best.cell, -1)::BIGINT AS cluster, round(best.distance, 6) AS distance
FROM p LEFT JOIN best ON p.id = best.id"""
ORACLE["window_outlier_counts_all"] = f"""WITH {_COUNT_WIN}, n AS (SELECT e, count(*) AS n FROM w GROUP BY e)
SELECT w.e AS window_end, sum(CASE WHEN n - 1 < {K_WIN} THEN 1 ELSE 0 END)::BIGINT AS outliers
FROM w JOIN n ON w.e = n.e GROUP BY w.e"""
ORACLE["rank_limit"] = f"""SELECT 0::BIGINT AS query_id, neighbor_id, round(distance, 6) AS distance, rank FROM (
  SELECT b.event_id AS neighbor_id, abs(a.value - b.value) AS distance,
         row_number() OVER (ORDER BY abs(a.value - b.value), b.event_id) AS rank
  FROM events a JOIN events b ON a.event_id = 0 AND b.event_id <> 0) WHERE rank <= {LIMIT}"""
ORACLE["radius_join_custom_metric"] = f"""SELECT a.event_id AS query_id, b.event_id AS neighbor_id, round(abs(a.value - b.value) / 10, 6) AS distance
FROM events a JOIN events b ON a.event_id <> b.event_id AND b.value BETWEEN a.value - 1 AND a.value + 1
 AND abs(a.value - b.value) / 10 <= {_d(R_PAIRS / 10)}"""
ORACLE["knn_within_partitioned"] = f"""SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank::INTEGER AS rank, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM (
    SELECT a.event_id AS query_id, b.event_id AS neighbor_id, a.event_type, abs(a.value - b.value) AS distance
    FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_id <> b.event_id
     AND b.value BETWEEN a.value - 1 AND a.value + 1 AND abs(a.value - b.value) <= {_d(R_PAIRS)}))
WHERE rank <= {K_ND}"""
ORACLE["text_points"] = "SELECT event_id AS id, value FROM events"
ORACLE["new_in_window"] = f"WITH {_COUNT_WIN} SELECT e AS \"window\", id FROM w WHERE id >= (e - 1) * {COUNT_S}"
ORACLE["expiring"] = f"WITH {_COUNT_WIN} SELECT e AS \"window\", id FROM w WHERE id < (e - {COUNT_W // COUNT_S} + 1) * {COUNT_S}"
ORACLE["sample_n"] = f"""SELECT event_id AS id, value FROM events
ORDER BY md5(event_id::VARCHAR || ':{SAMPLE_SEED}'), event_id LIMIT {SAMPLE_N}"""

_COORD_DIFFS = "list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: abs(x[1] - x[2]))"
_MANHATTAN = f"list_sum({_COORD_DIFFS})"
_CHEBYSHEV = f"list_max({_COORD_DIFFS})"


def _knn_sql(pairs: str, k: int, within: str = "true") -> str:
    return f"""SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM ({pairs}) WHERE {within})
WHERE rank <= {k}"""


def _pairs_sql(distance: str, prefix: str = "") -> str:
    ids = ", ".join(f"{prefix}{t}.vec_id AS {n}" for t, n in (("a", "query_id"), ("b", "neighbor_id")))
    return f"SELECT {ids}, {distance} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"


ORACLE["knn_manhattan"] = _knn_sql(_pairs_sql(_MANHATTAN), K_ND)
ORACLE["knn_text_ids"] = _knn_sql(_pairs_sql(_VEC_DIST, "'v' || "), K_ND)
ORACLE["knn_int_vectors"] = _knn_sql(_pairs_sql("""list_distance(
    list_transform(a.embedding, lambda x: floor(x::DOUBLE * 10)), list_transform(b.embedding, lambda x: floor(x::DOUBLE * 10)))"""), K_ND)
ORACLE["knn_within_chebyshev"] = _knn_sql(_pairs_sql(_CHEBYSHEV), K_ND, f"distance <= {_d(R_CHEBYSHEV)}")
ORACLE["radius_join_manhattan"] = f"""SELECT query_id, neighbor_id, round(distance, 6) AS distance FROM ({_pairs_sql(_MANHATTAN)})
WHERE distance <= {_d(R_MANHATTAN)}"""
ORACLE["nearest_center_manhattan"] = f"""WITH e AS (SELECT label, pos, avg(x::DOUBLE) AS x
           FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
           GROUP BY label, pos),
  b AS (SELECT label::BIGINT AS center_id, list(x ORDER BY pos) AS embedding FROM e GROUP BY label),
  d AS (SELECT a.vec_id AS id, b.center_id, {_MANHATTAN} AS distance FROM embeddings a, b),
  best AS (SELECT id, arg_min(center_id, (distance, center_id)) AS center_id, min(distance) AS distance
           FROM d WHERE distance <= {_d(R_MANHATTAN)} GROUP BY id)
SELECT a.vec_id AS id, coalesce(best.center_id, -1)::BIGINT AS center_id, round(best.distance, 6) AS distance
FROM embeddings a LEFT JOIN best ON a.vec_id = best.id"""
ORACLE["outliers_manhattan"] = f"""SELECT a.vec_id AS id, count(b.query_id) AS neighbors
FROM embeddings a LEFT JOIN (SELECT query_id FROM ({_pairs_sql(_MANHATTAN)}) WHERE distance <= {_d(R_OUTLIER)}) b ON a.vec_id = b.query_id
GROUP BY a.vec_id HAVING count(b.query_id) < {K_ND}"""
_ND_PROFILE = f"""WITH near AS (SELECT query_id, neighbor_id FROM ({_pairs_sql(_VEC_DIST)}) WHERE distance <= {_d(ND_R)}),
  w AS (SELECT vec_id AS id, vec_id // {ND_S} AS pane, vec_id // {ND_S} + j AS e FROM embeddings, range(1, {ND_W // ND_S + 1}) t(j)),
  nb AS (SELECT a.e, a.id, count(n.neighbor_id) FILTER (WHERE n.neighbor_id // {ND_S} <= a.pane) AS prec,
                count(n.neighbor_id) AS nb
         FROM w a LEFT JOIN (SELECT w.e, near.* FROM near JOIN w ON w.id = near.neighbor_id) n
           ON n.e = a.e AND n.query_id = a.id
         GROUP BY a.e, a.id, a.pane)"""
ORACLE["window_outlier_counts_nd"] = f"""{_ND_PROFILE}
SELECT e AS window_end, count(*) FILTER (WHERE nb < {K_ND}) AS outliers FROM nb GROUP BY e"""
ORACLE["neighbor_profile_nd"] = f"""{_ND_PROFILE}
SELECT e AS window_end, id, prec AS preceding, nb - prec AS succeeding, nb AS neighbors, nb - prec >= {K_ND} AS safe_inlier FROM nb"""
ORACLE["window_outliers_xy"] = f"""WITH p AS (SELECT event_id AS id, value, user_id, epoch_us(ts) // {DAY_US} AS pane FROM events),
  w AS (SELECT id, value, user_id, pane + j AS e FROM p, range(1, 3) t(j)),
  nb AS (SELECT a.e, a.id, count(*) - 1 AS nb
         FROM w a JOIN w b ON a.e = b.e AND b.user_id BETWEEN a.user_id - 6 AND a.user_id + 6
          AND greatest(abs(a.value - b.value), abs(a.user_id::DOUBLE - b.user_id::DOUBLE)) <= {_d(XY_R)}
         GROUP BY a.e, a.id)
SELECT make_timestamp(e * {DAY_US}) AS window_end, id, nb AS neighbors FROM nb WHERE nb < {XY_K}"""


def _cover_sql(rows: str, half: float, k: int) -> str:
    """Clusters per window of ``rows`` (e, id, embedding): the greedy pass over the dense
    balls in the order of md5(id), then every point to its nearest centre."""
    return f"""WITH RECURSIVE w AS ({rows}),
  near AS (SELECT a.e, a.id, b.id AS other, {_VEC_DIST} AS distance FROM w a JOIN w b ON a.e = b.e AND {_VEC_DIST} <= {_d(half)}),
  ball AS (SELECT e, id FROM near GROUP BY e, id HAVING count(*) > {k}),
  cand AS (SELECT n.e, n.id, list(n.other) AS others, min(c.i) AS i FROM near n
           JOIN (SELECT *, row_number() OVER (PARTITION BY e ORDER BY md5(id::VARCHAR)) AS i FROM ball) c ON n.e = c.e AND n.id = c.id
           GROUP BY n.e, n.id),
  pass AS (SELECT e, 0::BIGINT AS i, []::BIGINT[] AS chosen FROM (SELECT DISTINCT e FROM cand)
           UNION ALL
           SELECT p.e, c.i, CASE WHEN list_has_any(p.chosen, c.others) THEN p.chosen ELSE list_append(p.chosen, c.id) END
           FROM pass p JOIN cand c ON c.e = p.e AND c.i = p.i + 1),
  centre AS (SELECT e, unnest(arg_max(chosen, i)) AS center_id FROM pass GROUP BY e),
  member AS (SELECT n.e, n.id, arg_min(n.other, (n.distance, n.other)) AS center_id, min(n.distance) AS distance
             FROM near n JOIN centre c ON n.e = c.e AND n.other = c.center_id GROUP BY n.e, n.id)
"""


ORACLE["dense_clusters_nd"] = _cover_sql(f"""SELECT vec_id AS id, vec_id // {ND_S} + j AS e, embedding
    FROM embeddings, range(1, {ND_W // ND_S + 1}) t(j)""", R_BALL / 2, K_BALL) + """SELECT e AS window_end, center_id, count(*) AS points
FROM member GROUP BY e, center_id"""
ORACLE["assign_clusters_nd"] = _cover_sql("SELECT vec_id AS id, 0 AS e, embedding FROM embeddings", R_BALL / 2, K_BALL) + """SELECT w.id, coalesce(m.center_id, -1)::BIGINT AS center_id, round(m.distance, 6) AS distance
FROM w LEFT JOIN member m ON w.id = m.id"""
