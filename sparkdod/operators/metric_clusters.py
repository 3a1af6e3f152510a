"""Dense clusters of vectors, or of objects of any metric.

A ball of radius ``R / 2`` that holds more than ``k`` points of a window is dense: its
members are within ``R`` of each other, so all are inliers. Centres are points
with a dense ball, chosen so that no two are within ``R / 2`` and every point with a dense
ball is within ``R / 2`` of one: a maximal independent set, the one that a greedy pass in
the order of ``md5(id)`` would take.

That order is random, so the pass needs few parallel rounds (about the logarithm of the
candidates): a candidate that comes first among the undecided ones near it is a
centre, and those near a centre are out. Where a window holds many candidates, the first
``FIRST_TURNS`` of them are decided in such rounds, those near their centres are out, then
``MORE_TURNS`` times as many: all candidates meet the centres, but only few
meet each other. A block emits the first of the neighbours for each candidate, not the
neighbours; equal objects are one row. No edge of the graph is ever stored.

Every point belongs to the nearest centre within ``R / 2`` (ties to the lowest id).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.block_metrics import BlockMetric, euclidean_blocks
from ..plans.partitioning import materialize
from .metric_search import PIVOTS, PivotIndex, _label, _points, build_index, metric_window_counts
from .outliers import _source_key
from .windows import Windows

FIRST_TURNS = 4_096      # candidates of one window that are decided first
MORE_TURNS = 4


def _independent(index: PivotIndex, radius: float) -> DataFrame:
    """Rows of the index (window, obj, first, neighbor_id) that are centres."""
    def first_of(q, o, pairs):
        names, order = np.unique(o["turn"].to_numpy().astype(str), return_inverse=True)
        least = np.full(len(q), len(names))
        np.minimum.at(least, pairs[0], order[pairs[1]])
        hit = np.flatnonzero(least < len(names))
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[hit], "turn": names[least[hit]].astype(object)})

    def reached(q, o, pairs):
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[np.unique(pairs[0])]})

    def met(queries: DataFrame, rows: DataFrame, n: int, kernel, schema: str) -> DataFrame:
        objects = index.fewer(index.placed.join(rows.select("neighbor_id"), "neighbor_id", "left_semi"), min(1.0, n / total))
        visits = objects.visits(queries.select("window", "obj", F.col("neighbor_id").alias("query_id")), radius, 0)
        return objects.evaluate(visits, ["window"], kernel, schema, radius)

    def out_of_reach(rows: DataFrame, won: DataFrame, n: int) -> DataFrame:
        near = met(rows, won, n, reached, "query_id long").distinct()
        return materialize(rows.join(near, F.col("neighbor_id") == F.col("query_id"), "left_anti"))
    columns = ["window", "obj", "first", "turn", "neighbor_id"]
    later = materialize(index.placed.select(*columns))
    total, share, centres = later.count(), FIRST_TURNS / index.most, []
    while not later.isEmpty():
        last = 2 * share >= 1
        cut = F.lit(f"{int(share * 2.0 ** 52):013x}" if not last else "g")  # of hex digits: all come before a "g"
        alive, batch = later if last else materialize(later.where(F.col("turn") < cut)), []
        while not alive.isEmpty():
            least = met(alive, alive, alive.count(), first_of, "query_id long, turn string").groupBy("query_id").agg(F.min("turn").alias("least"))
            won = materialize(alive.join(least, F.col("neighbor_id") == F.col("query_id")).where("turn = least").select(*columns))
            batch.append((won, won.count()))
            alive = out_of_reach(alive, *batch[-1])
        centres += [won for won, _ in batch]
        if last:
            break
        later = materialize(later.where(F.col("turn") >= cut))
        if batch:
            found = batch[0][0]
            for more, _ in batch[1:]:
                found = found.unionByName(more)
            later = out_of_reach(later, found, sum(n for _, n in batch))
        share *= MORE_TURNS
    result = centres[0]
    for more in centres[1:]:
        result = result.unionByName(more)
    return result


def _clustered(points: DataFrame, windows: Windows | None, radius: float, k: int, metric: BlockMetric, id_col: str,
               vector_col: str, pivots: int, block_rows: int | None) -> DataFrame | None:
    """(window, obj, mult, center_id, distance) of the objects in a cluster; None without a cluster."""
    half = float(radius) / 2
    counts = metric_window_counts(points, windows, half, metric=metric, id_col=id_col, vector_col=vector_col,
                                  pivots=pivots, block_rows=block_rows, enough=k)
    if counts is None:
        return None
    objects = materialize(counts.groupBy("window", "obj").agg(F.sum("mult").alias("mult"), F.max("total").alias("total"), F.min("first").alias("first"))
                          .withColumn("query_id", F.monotonically_increasing_id()))
    dense = objects.where(F.col("total") > k).select("window", "obj", "first", F.md5(F.col("first").cast("string")).alias("turn"))
    index = build_index(dense, metric, 0, pivots, block_rows, ["window"])
    if index is None:
        return None
    centres = build_index(_independent(index, half).select("window", "obj", "first"), metric, 0, pivots, block_rows, ["window"])

    def nearest(q, o, pairs):
        rows, cols, dist = pairs
        order = np.unique(o["first"].to_numpy(), return_inverse=True)[1]
        turn = np.lexsort((order[cols], dist, rows))  # of equal distances the lowest id
        hit, at = np.unique(rows[turn], return_index=True)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[hit], "center_id": o["first"].to_numpy()[cols[turn[at]]], "distance": dist[turn[at]]})
    kind = dense.schema["first"].dataType.simpleString()
    visits = centres.visits(objects.select("window", "obj", "query_id"), half, 0)
    found = centres.evaluate(visits, ["window"], nearest, f"query_id long, center_id {kind}, distance double", half)
    best = found.groupBy("query_id").agg(F.min(F.struct("distance", "center_id")).alias("b"))
    return objects.join(best, "query_id").select("window", "obj", "mult", F.col("b.center_id").alias("center_id"), F.col("b.distance").alias("distance"))


def dense_clusters_nd(points: DataFrame, windows: Windows | None, radius: float, k: int, *, metric: BlockMetric = euclidean_blocks,
                      id_col: str = "id", vector_col: str = "vec", pivots: int = PIVOTS, block_rows: int | None = None) -> DataFrame:
    """(window_end, center_id, points) of every cluster; ``points`` are those nearer to
    this centre than to others. Of equal objects the centre is the lowest id."""
    c = _clustered(points, windows, radius, k, metric, id_col, vector_col, pivots, block_rows)
    if c is None:
        c = points.limit(0).select(F.lit(0).cast("long").alias("window"), F.col(id_col).alias("center_id"), F.lit(0).cast("long").alias("mult"))
    return c.groupBy("window", "center_id").agg(F.sum("mult").alias("points")) \
        .select(_label(windows, points).alias("window_end"), "center_id", "points")


def assign_clusters_nd(points: DataFrame, windows: Windows | None, radius: float, k: int, *, metric: BlockMetric = euclidean_blocks,
                       id_col: str = "id", vector_col: str = "vec", pivots: int = PIVOTS, block_rows: int | None = None) -> DataFrame:
    """(window_end, id, center_id, distance) of every point in each of its windows; centre
    and distance are NULL where no cluster is within ``radius / 2``."""
    c = _clustered(points, windows, radius, k, metric, id_col, vector_col, pivots, block_rows)
    key = _source_key(points, windows)
    p = _points(points, id_col, vector_col, src=key)
    if windows is None or windows.panes_per_window is None:
        p = p.withColumn("window", F.col("src"))
    else:
        p = p.withColumn("window", F.explode(F.sequence(F.col("src") + 1, F.col("src") + windows.panes_per_window)))
    if c is None:
        out = p.withColumn("center_id", F.lit(None).cast(p.schema["id"].dataType)).withColumn("distance", F.lit(None).cast("double"))
    else:
        out = p.join(c, ["window", "obj"], "left")
    return out.select(_label(windows, points).alias("window_end"), "id", "center_id", "distance")
