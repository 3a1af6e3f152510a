"""Neighbour search as DataFrame joins.

A distance predicate alone would make Spark plan a nested-loop join. Here
every search is an *equi*-join on grid cells followed by the exact
predicate:

* 1-D: cells of width R; a probe looks up the cells its radius touches.
* n-D: projections on a few principal axes act as coordinates
  (``|u.x - u.y| <= |x - y|`` for a unit ``u``); a grid over them never
  separates two points within R (the distributed analogue of the
  metric-tree pruning in the reference), and the candidates of one grid
  cell are evaluated as a numpy block.

kNN of numbers goes by rank (no radius). kNN of vectors grows the radius in
rounds until every query has ``k`` answers; a query leaves as soon as its
answer is complete, so late rounds touch few rows. NULL, NaN and infinite
values, and vectors holding one, are no points (D5).
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import abs_distance, euclidean, resolve_metric
from ..plans.partitioning import materialize, spread
from .blocks import DEFAULT_BLOCK_ROWS, block_radius_counts, block_radius_pairs, block_radius_topk
from .cells import MOST_CELLS, grid_cell, grid_reach, grid_width
from .neighbors import check_radius
from .ranking import knn_by_rank, knn_within_by_rank, numbered

_log = logging.getLogger(__name__)

# Relative slack of the largest possible distance (sums of norms).
_ND_SLACK = 2.0 ** -36


class Axes(list):
    """Unit directions, a ``centre`` that is subtracted before projecting, and ``far``: no vector is
    farther from the centre (None: not measured)."""

    def __init__(self, directions=(), centre: Sequence[float] = (), far: float | None = None):
        super().__init__(directions)
        self.centre, self.far = list(centre), far


def _projection_slack(distance: Column, r: float, dims: int) -> Column:
    """How far the computed projections of two vectors within ``r`` can be apart beyond ``r``, for one at
    ``distance`` from the centre: each is a sum of ``dims`` products, so its error is below
    ``dims * 2**-53`` of that distance, and the directions' own rounding adds as much again."""
    return (distance + F.lit(r)) * F.lit(4.0 * (dims + 8) * 2.0 ** -53)


def _is_vector(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() == "array"


def _as_shipped(df: DataFrame, col: str) -> Column:
    """A vector for the blocks, which compute in DOUBLE: FLOAT holds the same numbers in half the bytes."""
    return F.col(col) if df.schema[col].dataType.simpleString() == "array<float>" else F.col(col).cast("array<double>")


def finite(col: str, vector: bool):
    """Condition for a usable number or vector."""
    if vector:
        v = F.col(col).cast("array<double>")
        return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.col(col).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


# objects of a cell that a task holds at once in a join of numbers
HELD_ROWS = 2 ** 19

# rows the principal axes are fitted on: those of the smallest hashes
AXES_SAMPLE = 10_000


def choose_axes(data: DataFrame, vector_col: str = "vec", n: int = 2, dims: int | None = None) -> Axes:
    """``n`` orthonormal directions of largest spread: PCA fitted on
    ``AXES_SAMPLE`` rows at most (only a ``dims x n`` matrix reaches the
    driver). None for fewer than two rows or no dimensions.

    Any unit vector ``u`` gives the exact bound ``|u.x - u.y| <= |x - y|``,
    so the sample only affects how well the grid separates points, never
    the result. Projections are of differences to one of the rows, so coordinates far
    from zero (times, say) cost no precision."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    data = data.where(finite(vector_col, True))
    rows = data.select(F.col(vector_col).cast("array<double>").alias("__v")).take(2)
    if len(rows) < 2 or n <= 0:
        return Axes()
    centre = rows[0][0]
    far = F.max(_distance_to(F.col(vector_col).cast("array<double>"), centre))
    if dims is None:
        dims, far = data.select(F.min(F.size(vector_col)), far).first()
    else:
        far = data.select(far).first()[0]
    if not dims or dims <= 0:
        return Axes()
    src = data.select(F.slice(F.col(vector_col).cast("array<double>"), 1, dims).alias("__v")) \
        .orderBy(F.xxhash64("__v")).limit(AXES_SAMPLE)
    model = PCA(k=min(n, dims), inputCol="__f", outputCol="__p").fit(src.select(array_to_vector("__v").alias("__f")))
    pc = model.pc.toArray()
    return Axes([[float(x) for x in pc[:, j] / math.sqrt(float((pc[:, j] ** 2).sum()) or 1.0)] for j in range(pc.shape[1])], centre[:dims], far)


def _distance_to(vec: Column, centre: Sequence[float]) -> Column:
    """Distance of the common prefix to a fixed vector (no vector: the norm)."""
    size = len(centre)
    diff = F.zip_with(F.slice(vec, 1, size), F.slice(F.array(*[F.lit(float(c)) for c in centre]), F.lit(1), F.least(F.size(vec), F.lit(size))), lambda x, c: x - c) if size else vec
    return F.sqrt(F.aggregate(F.transform(diff, lambda x: x * x), F.lit(0.0).cast("double"), lambda acc, z: acc + z))


def _axis_coords(df: DataFrame, vector_col: str, axes: Axes, dims: int) -> DataFrame:
    """Projection ``__pd{j}`` on every axis (over the first ``dims`` values)
    and the distance ``__nrm`` from the centre (for the rounding slack)."""
    centre = (axes.centre + [0.0] * dims)[:dims]
    diff = F.zip_with(F.slice(F.col(vector_col).cast("array<double>"), 1, dims), F.array(*[F.lit(c) for c in centre]), lambda x, c: x - c) \
        if any(centre) else F.slice(F.col(vector_col).cast("array<double>"), 1, dims)
    df = df.withColumn("__diff", diff)
    for j, u in enumerate(axes):
        lit = F.array(*[F.lit(float(x)) for x in u[:dims]])
        df = df.withColumn(f"__pd{j}", F.aggregate(F.zip_with("__diff", lit, lambda x, y: x * y),
                                                  F.lit(0.0).cast("double"), lambda acc, z: acc + z))
    return df.withColumn("__nrm", F.sqrt(F.aggregate(F.transform("__diff", lambda x: x * x),
                                                     F.lit(0.0).cast("double"), lambda acc, z: acc + z))).drop("__diff")


def _vectors(data: DataFrame, metric, vector_col: str) -> bool:
    return metric == "euclidean" or (metric == "auto" and vector_col in data.columns and _is_vector(data, vector_col))


def radius_join(queries: DataFrame, data: DataFrame, radius: float, *, metric: str = "auto",
                id_col: str = "id", value_col: str = "value", vector_col: str = "vec",
                include_self: bool = True, partition_cols: Sequence[str] = (),
                axes: int | Sequence[Sequence[float]] = 2, dims=None, grid_radius: float | None = None,
                split: bool = True) -> DataFrame:
    """All (query, object) pairs with ``distance <= radius`` (inclusive).

    Returns (query_id, neighbor_id, distance[, partition_cols]). The query
    object is returned when it is in the data unless ``include_self=False``
    (then equal ids are skipped). ``partition_cols`` restrict pairs to equal
    keys (e.g. a window). 1-D by ``value_col`` with ``abs``, n-D by
    ``vector_col`` with Euclidean (shorter-prefix) distance.

    ``metric`` may be a ``(Column, Column) -> Column`` of numbers (U1). The
    grid then needs ``grid_radius``: a bound on ``abs(a - b)`` for every pair
    whose distance is within ``radius``.

    A cell of numbers that holds much of the work is dealt to many tasks (``_split_cells``, which counts both
    sides first); ``split=False`` leaves that out, where the objects of a cell are few."""
    r = check_radius(radius)
    if callable(metric) and grid_radius is None:
        raise ValueError("a distance of your own needs grid_radius, a bound on abs(a - b) within the radius")
    queries = queries.where(finite(vector_col if _vectors(data, metric, vector_col) else value_col, _vectors(data, metric, vector_col)))
    data = data.where(finite(vector_col if _vectors(data, metric, vector_col) else value_col, _vectors(data, metric, vector_col)))
    keys = list(partition_cols)
    if not _vectors(data, metric, vector_col):
        dist_fn = resolve_metric("abs" if metric == "auto" else metric)
        reach = r if grid_radius is None else check_radius(grid_radius)
        width = grid_width(reach)
        q = queries.select(*[F.col(c).alias(c) for c in keys], F.col(id_col).alias("query_id"), F.col(value_col).cast("double").alias("qv"),
                           F.explode(grid_reach(F.col(value_col).cast("double"), reach, width)).alias("__c"))
        d = data.select(*[F.col(c).alias(c) for c in keys], F.col(id_col).alias("neighbor_id"), F.col(value_col).cast("double").alias("dv"),
                        grid_cell(F.col(value_col).cast("double"), width).alias("__c"))
        dist = dist_fn(F.col("qv"), F.col("dv"))
        jkeys = keys + ["__c"]
        if split:
            q, d, jkeys = _split_cells(q, d, jkeys)
            d = spread(d, *jkeys)  # the streamed side, should Spark broadcast the queries
        j = spread(q, *jkeys).join(d, jkeys)
    else:
        q, d, jkeys = _axis_grid(queries, data, r, id_col, vector_col, keys, axes, dims)
        out = block_radius_pairs(q, d, jkeys, r, include_self, passthrough=keys)
        return out.select("query_id", "neighbor_id", "distance", *keys)
    j = j.where(dist <= F.lit(r))
    if not include_self:
        j = j.where(F.col("query_id") != F.col("neighbor_id"))
    return j.select("query_id", "neighbor_id", dist.alias("distance"), *keys)


def _split_cells(q: DataFrame, d: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cells with more than a fair share of all candidate pairs (half a core's) are hash-split into chunks on both
    sides, each query chunk meeting each object chunk of its cell, so that no chunk pair is above that share; an
    object chunk also has about ``HELD_ROWS`` rows at most, since a task holds the objects of a key.

    A row is copied at most about ``sqrt(2 * cores)`` times by the share, however large the input, and only in
    such cells; beyond that once for every ``HELD_ROWS`` objects of one cell. At most ``2 * cores`` cells
    and one for every ``HELD_ROWS`` objects are listed, so the list is broadcast. Rows that agree in
    id and value stay together."""
    sizes = materialize(q.groupBy(*keys).agg(F.count(F.lit(1)).alias("__qn")).join(
        d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__dn")), keys).withColumn("__n", F.col("__qn").cast("double") * F.col("__dn")))
    total, most, held = sizes.agg(F.sum("__n"), F.max("__n"), F.max("__dn")).first()
    share = (total or 0.0) / (2 * q.sparkSession.sparkContext.defaultParallelism)
    if total is None or (most <= share and held <= HELD_ROWS):
        return q, d, keys
    chunks = F.ceil(F.sqrt(F.col("__n") / F.lit(share)))
    large = F.broadcast(sizes.where((F.col("__n") > F.lit(share)) | (F.col("__dn") > F.lit(HELD_ROWS))).select(
        *keys, chunks.alias("__cq"), F.greatest(chunks, F.ceil(F.col("__dn") / F.lit(HELD_ROWS))).alias("__cd")))

    def dealt(df: DataFrame, row: Sequence[str], own: str, other: str) -> DataFrame:
        one = F.lit(1).cast("long")
        n, copies = F.coalesce(F.col(f"__c{own}"), one), F.coalesce(F.col(f"__c{other}"), one)
        return df.join(large, keys, "left").select(*df.columns, F.pmod(F.xxhash64(*row), n).alias(f"__k{own}"),
                                                   F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias(f"__k{other}"))
    return dealt(q, ("query_id", "qv"), "q", "d"), dealt(d, ("neighbor_id", "dv"), "d", "q"), keys + ["__kq", "__kd"]


def _vector_dims(data: DataFrame, vector_col: str) -> tuple[int, int]:
    lo, hi = data.select(F.min(F.size(vector_col)), F.max(F.size(vector_col))).first()
    return int(lo or 0), int(hi or 0)


def _axis_grid(queries, data, r, id_col, vector_col, keys, axes, dims=None):
    """Projection filtering as an equi-join key: the projection on each axis
    is a coordinate (``|u.x - u.y| <= |x - y|`` for a unit ``u``), and a grid
    of width R over those coordinates never separates two points within R.
    The probe side lists every cell its radius (plus rounding slack) touches: at most four on
    an axis, as a query whose slack is wider than that looks into a second, coarser level of cells.
    Projections use the first ``min length`` values of both sides, which keeps
    the bound valid for vectors of different lengths (distance = shorter prefix).
    Returns (queries, data, key columns) with ``qvec`` / ``dvec`` as FLOAT arrays where they are such
    already, else as DOUBLE ones."""
    queries, data = queries.where(finite(vector_col, True)), data.where(finite(vector_col, True))
    both = queries.select(F.col(vector_col).cast("array<double>").alias("__b")).unionByName(data.select(F.col(vector_col).cast("array<double>").alias("__b")))
    if dims is None:
        dims = _vector_dims(both, "__b")
    lo_dims = dims[0] if isinstance(dims, tuple) else dims
    if isinstance(axes, int):
        axes = choose_axes(both, "__b", axes, lo_dims)
    elif not isinstance(axes, Axes):
        axes = Axes(axes)
    far = axes.far
    if far is None and axes:
        far = both.select(F.max(_distance_to(F.col("__b"), axes.centre))).first()[0]
    width = grid_width(r)
    most = 4.0 * (lo_dims + 8) * 2.0 ** -53 * ((far or 0.0) + r)  # the largest slack
    coarse = grid_width(2 * most) if most > width / 2 else None
    # re-aliased keys get fresh attribute ids on each side, so a self-join
    # (queries and data from one table) stays unambiguous in the cogroup
    qkeys = [F.col(k).alias(k) for k in keys]
    dkeys = [F.col(k).alias(k) for k in keys]
    qc = _axis_coords(queries.select(*qkeys, F.col(id_col).alias("query_id"),
                                     _as_shipped(queries, vector_col).alias("qvec")), "qvec", axes, lo_dims)
    dc = _axis_coords(data.select(*dkeys, F.col(id_col).alias("neighbor_id"),
                                  _as_shipped(data, vector_col).alias("dvec")), "dvec", axes, lo_dims)
    slack, cell_cols, level = _projection_slack(F.col("__nrm"), r, lo_dims), [], []
    size = F.lit(width)
    if coarse:
        qc = qc.withColumn("__lv", (slack > F.lit(width / 2)).cast("int"))
        dc = dc.withColumn("__lv", F.explode(F.array(F.lit(0), F.lit(1))))
        size, level = F.when(F.col("__lv") == 0, F.lit(width)).otherwise(F.lit(coarse)), ["__lv"]

    def cell(x):
        return F.floor(F.greatest(F.least(x / size, F.lit(MOST_CELLS)), F.lit(-MOST_CELLS))).cast("long")
    for j in range(len(axes)):
        pd_ = F.col(f"__pd{j}")
        qc = qc.withColumn(f"__c{j}", F.explode(F.sequence(cell(pd_ - F.lit(r) - slack), cell(pd_ + F.lit(r) + slack))))
        dc = dc.withColumn(f"__c{j}", cell(pd_))
        cell_cols.append(f"__c{j}")
    if not axes:  # nothing to prune by: one cell, cut into blocks
        qc, dc, cell_cols = qc.withColumn("__c0", F.lit(0).cast("long")), dc.withColumn("__c0", F.lit(0).cast("long")), ["__c0"]
    cell_cols += level
    drop = [f"__pd{j}" for j in range(len(axes))] + ["__nrm"]
    return qc.drop(*drop), dc.drop(*drop), list(keys) + cell_cols


def _candidate_blocks(queries: DataFrame, data: DataFrame, r: float, id_col: str, value_col: str,
                      vector_col: str, axes, dims):
    """Query and data rows keyed by grid cells for blockwise evaluation:
    (keys..., query_id, qvec) and (keys..., neighbor_id, dvec). Numbers
    become one-element vectors on a grid of width R; vectors use the principal-axis
    grid."""
    if vector_col in data.columns and _is_vector(data, vector_col):
        q, d, keys = _axis_grid(queries, data, r, id_col, vector_col, [], axes, dims)
        return q.select(*keys, "query_id", "qvec"), d.select(*keys, "neighbor_id", "dvec"), keys
    width = grid_width(r)
    v = F.col(value_col).cast("double")
    queries, data = queries.where(finite(value_col, False)), data.where(finite(value_col, False))
    q = queries.select(F.col(id_col).alias("query_id"), F.array(v).alias("qvec"),
                       F.explode(grid_reach(v, r, width)).alias("__c"))
    d = data.select(F.col(id_col).alias("neighbor_id"), F.array(v).alias("dvec"),
                            grid_cell(v, width).alias("__c"))
    return q, d, ["__c"]


def radius_topk(queries: DataFrame, data: DataFrame, radius: float, k: int, *, include_self: bool = True,
                id_col: str = "id", value_col: str = "value", vector_col: str = "vec", axes=2, dims=None,
                block_rows: int = DEFAULT_BLOCK_ROWS, counts: bool = True) -> DataFrame:
    """Per query and block the ``k`` nearest within ``radius`` plus the
    block's count (see ``block_radius_topk``): (query_id, neighbor_id,
    distance, n). Never emits more than ``k`` rows per query and block."""
    q, d, keys = _candidate_blocks(queries, data, float(radius), id_col, value_col, vector_col, axes, dims)
    return block_radius_topk(q, d, keys, radius, k, include_self, block_rows, counts)


def _top_k(pairs: DataFrame, k: int, group: Sequence[str] = ("query_id",)) -> DataFrame:
    """Rank per query by (distance, neighbor_id); Spark plans the rank filter
    as a group limit before the shuffle."""
    w = Window.partitionBy(*group).orderBy("distance", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_within(queries: DataFrame, data: DataFrame, k: int, radius: float, **kw) -> DataFrame:
    """At most ``k`` nearest objects within ``radius`` per query, ranked
    by (distance, id). ``k <= 0`` gives an empty result. Numbers with ``partition_cols`` go by rank:
    no pair is formed beyond the ``k`` on either side."""
    if k <= 0:
        return radius_join(queries, data, radius, **kw, split=False).limit(0).withColumn("rank", F.lit(0))
    metric, keys, vector_col = kw.get("metric", "auto"), list(kw.get("partition_cols", ())), kw.get("vector_col", "vec")
    if keys and metric in ("auto", "abs") and kw.get("grid_radius") is None and not _vectors(data, metric, vector_col):
        number, id_col = kw.get("value_col", "value"), kw.get("id_col", "id")
        queries, data = queries.where(finite(number, False)), data.where(finite(number, False))
        return knn_within_by_rank(queries.select(*keys, F.col(id_col).alias("query_id"), F.col(number).cast("double").alias("qv")),
                                  data.select(*keys, F.col(id_col).alias("neighbor_id"), F.col(number).cast("double").alias("dv")),
                                  k, check_radius(radius), kw.get("include_self", True), keys)
    if kw.get("partition_cols") or kw.get("metric", "auto") != "auto":
        return _top_k(radius_join(queries, data, radius, **kw), k, ["query_id", *kw.get("partition_cols", ())])
    kw.pop("metric", None)
    kw.pop("partition_cols", None)
    return _top_k(radius_topk(queries, data, radius, k, **kw, counts=False).drop("n"), k)


def _random_pair_distances(data: DataFrame, dist_of, id_col: str, coord: str, n: int,
                            seed: int = 11) -> DataFrame:
    """About n/2 disjoint random pairs (points hashed into buckets of ~2) and
    their distances; each bucket contributes one pair."""
    n_buckets = F.lit(max(1, n // 2)).cast("long")
    h = data.select(F.col(coord).alias("__x"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("__h"))
    g = h.groupBy(F.pmod("__h", n_buckets).alias("__b")).agg(
        F.min_by("__x", "__h").alias("a"), F.max_by("__x", "__h").alias("b"), F.count(F.lit(1)).alias("c"))
    return g.where(F.col("c") >= 2).select(dist_of(F.col("a"), F.col("b")).alias("d"))


def knn_join(queries: DataFrame, data: DataFrame, k: int, *, id_col: str = "id", value_col: str = "value",
             vector_col: str = "vec", include_self: bool = False, start_radius: float | None = None,
             growth: float = 2.0, axes: int = 2, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest objects of every query (ties by object id); a
    query need not be an object, nor lie anywhere near one.

    Numbers: ``knn_by_rank``. Vectors, exact: round i joins the unfinished
    queries within radius ``r_i``; a query with at least ``k`` answers inside
    ``r_i`` is final (nothing outside can beat them); the rest go to the next
    round with ``r_i * growth``. No distance exceeds the largest norm of a
    query plus that of an object (over whole vectors), so the round that
    reaches it takes every object and is the last: the loop ends after
    ``log(bound / r_0)`` rounds. The first radius is about the typical k-th
    neighbour distance, from random pairs. Each round's partial lists are
    checkpointed once, and both the final answers and the unfinished queries
    are read from there. Blocks emit only their per-query top ``k``, so a
    round's output is bounded by queries x k x blocks even inside a dense
    cluster."""
    if k <= 0:
        return knn_within(queries, data, 0, 0.0, id_col=id_col, value_col=value_col, vector_col=vector_col)
    vector = vector_col in data.columns and _is_vector(data, vector_col)
    coord = vector_col if vector else value_col
    queries, data = queries.where(finite(coord, vector)), data.where(finite(coord, vector))
    if not vector:
        return knn_by_rank(queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(value_col).cast("double").alias("qv")),
                           data.select(F.col(id_col).cast("long").alias("neighbor_id"), F.col(value_col).cast("double").alias("dv")), k, include_self)
    pending = queries.select(F.col(id_col).alias(id_col), F.col(coord).cast("array<double>").alias(coord))
    data = data.select(F.col(id_col).alias(id_col), F.col(coord).cast("array<double>").alias(coord))
    both = pending.select(coord).unionByName(data.select(coord))
    dims = _vector_dims(both, coord)
    ax = choose_axes(both, coord, axes, dims[0])
    norm = F.sqrt(F.aggregate(F.transform(coord, lambda x: x * x), F.lit(0.0).cast("double"), lambda acc, z: acc + z))
    n, norm_d = data.agg(F.count(F.lit(1)), F.max(norm)).first()
    norm_q = pending.agg(F.max(norm)).first()[0]
    if not n or norm_q is None:
        return _empty_knn(queries.sparkSession)
    bound = (norm_d + norm_q) * (1 + _ND_SLACK) + 1e-300
    r = start_radius
    if not r:
        # the k-th smallest positive distance of n/2 random pairs: about 2k/n of all pairs lie within
        r = _random_pair_distances(data, euclidean, id_col, coord, n).where("d > 0").orderBy("d").limit(k + 1) \
            .agg(F.max("d")).first()[0]
    r = float(r) if r else bound
    done: list[DataFrame] = []
    while True:
        last = r >= bound
        r = min(r, bound)
        _log.info("knn round radius=%s", r)
        part = materialize(radius_topk(pending, data, r, k, include_self=include_self, id_col=id_col,
                                       vector_col=vector_col, axes=ax, dims=dims, block_rows=block_rows, counts=False))
        found = part.groupBy("query_id").agg(F.sum("n").alias("n"))
        ready = found if last else found.where(F.col("n") >= k)
        done.append(_top_k(part.join(ready.select("query_id"), "query_id", "left_semi").drop("n"), k))
        if last:
            break
        pending = materialize(pending.join(ready.select(F.col("query_id").alias(id_col)), id_col, "left_anti"))
        if pending.isEmpty():
            break
        r = r * growth
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _empty_knn(spark):
    return spark.createDataFrame([], "query_id long, neighbor_id long, distance double, rank int")


def distributed_rank(df: DataFrame, order_col: str, tie_col: str, out_col: str = "rank") -> DataFrame:
    """Global LONG rank by (order_col, tie_col) without funnelling all rows
    through one task (see ``ranking.numbered``)."""
    return numbered(df, order_col, tie_col, out_col=out_col)


def rank_by_distance(data: DataFrame, query, *, id_col: str = "id", value_col: str = "value",
                     vector_col: str = "vec", query_id=None, include_self: bool = True,
                     limit: int | None = None) -> DataFrame:
    """Every object ordered by distance to one query (a number, a vector,
    or ``query_id`` of a row of ``data``): (query_id, neighbor_id, distance,
    rank). ``limit`` keeps the first ``limit`` ranks (T2; ``<= 0`` -> empty)."""
    vector = vector_col in data.columns and _is_vector(data, vector_col)
    coord = vector_col if vector else value_col
    if query is None:
        row = data.where(F.col(id_col) == F.lit(query_id)).select(coord).first()
        if row is None:
            raise ValueError(f"no row with {id_col} = {query_id}")
        query = row[0]
    if vector:
        q = F.array(*[F.lit(float(x)) for x in query])
        dist = euclidean(F.col(vector_col), q)
    else:
        dist = abs_distance(F.col(value_col).cast("double"), F.lit(float(query)))
    out = data.select(F.lit(query_id).cast("long").alias("query_id"), F.col(id_col).alias("neighbor_id"),
                      dist.alias("distance"))
    if not include_self and query_id is not None:
        out = out.where(F.col("neighbor_id") != F.lit(query_id))
    if limit is not None:
        if limit <= 0:
            return out.limit(0).withColumn("rank", F.lit(0).cast("long"))
        out = out.orderBy("distance", "neighbor_id").limit(limit)  # a top-n of every task, then of those
    return distributed_rank(out, "distance", "neighbor_id")


def nearest_center(points: DataFrame, centers: DataFrame, threshold: float, *, id_col: str = "id",
                   center_id_col: str = "center_id", value_col: str = "value", vector_col: str = "vec",
                   center_value_col: str | None = None) -> DataFrame:
    """For every point the closest centre with ``distance <= threshold``
    (ties -> lowest centre id), or -1 and NULL distance when none is close.
    Returns (id, center_id, distance)."""
    vector = vector_col in points.columns and _is_vector(points, vector_col)
    coord = vector_col if vector else value_col
    cv = center_value_col or coord
    c = centers.select(F.col(center_id_col).alias(id_col), F.col(cv).alias(coord))
    pairs = radius_join(points.select(id_col, coord), c, threshold, id_col=id_col, value_col=value_col,
                        vector_col=vector_col, split=False)
    best = pairs.groupBy("query_id").agg(
        F.min_by(F.struct("neighbor_id", "distance"), F.struct("distance", "neighbor_id")).alias("b"))
    out = points.select(F.col(id_col).alias("query_id")).join(best, "query_id", "left")
    return out.select(F.col("query_id").alias(id_col),
                      F.coalesce(F.col("b.neighbor_id"), F.lit(-1)).cast("long").alias("center_id"),
                      F.col("b.distance").alias("distance"))


def count_neighbors(points: DataFrame, radius: float, *, id_col: str = "id", value_col: str = "value",
                    vector_col: str = "vec", axes: int = 2, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """A1 over one set: (id, neighbors), the point itself excluded; points
    without neighbours report 0. Values that are no points (D5) are left out.

    1-D values use the pair-free prefix-rank counts. Vectors are counted
    blockwise; no pair is ever emitted."""
    if not (vector_col in points.columns and _is_vector(points, vector_col)):
        from .neighbors import window_neighbor_counts
        c = window_neighbor_counts(points.select(F.col(id_col).alias("id"), F.col(value_col).alias("value")),
                                   None, radius)
        pts = points.select(F.col(id_col).alias("id"), F.col(value_col).cast("double").alias("value"))
        return pts.join(c, pts.value == c.v).select("id", (F.col("total") - 1).alias("neighbors"))
    q, d, keys = _axis_grid(points, points, float(radius), id_col, vector_col, [], axes, None)
    cnt = block_radius_counts(q.select(*keys, "query_id", "qvec"), d.select(*keys, "neighbor_id", "dvec"), keys, float(radius), False, block_rows) \
        .groupBy("query_id").agg(F.sum("cnt").alias("neighbors"))
    return points.where(finite(vector_col, True)).select(F.col(id_col).alias("query_id")).join(cnt, "query_id", "left") \
        .select(F.col("query_id").alias("id"), F.coalesce("neighbors", F.lit(0)).cast("long").alias("neighbors"))


def outlier_counts_nd(points: DataFrame, radius: float, k: int, *, id_col: str = "id", vector_col: str = "vec",
                      axes: int = 2, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(id, neighbors) of the vectors with fewer than ``k`` neighbours.

    Every grid cell first offers at most about ``block_rows`` hashed witness
    rows; a point with ``k`` neighbours among them is certainly no outlier,
    and only the others are compared with whole cells. Inside a dense cluster
    the work is linear, not quadratic."""
    r = float(radius)
    q, d, keys = _axis_grid(points, points, r, id_col, vector_col, [], axes, None)
    q = q.select(*keys, "query_id", "qvec")
    d = d.select(*keys, "neighbor_id", "dvec")
    ids = points.where(finite(vector_col, True)).select(F.col(id_col).alias("query_id"))

    def total(partials):
        return partials.groupBy("query_id").agg(F.sum("cnt").alias("neighbors"))
    stride = d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("long").alias("__s"))
    d_w = d.join(stride, keys).where(F.pmod(F.xxhash64("neighbor_id", F.lit(3)), F.col("__s")) == 0) \
        .select(*keys, "neighbor_id", "dvec")
    sampled = q.join(stride, keys, "left").groupBy("query_id").agg(
        F.max(F.coalesce(F.col("__s"), F.lit(1))).alias("__smax"))
    first = materialize(ids.join(total(block_radius_counts(q, d_w, keys, r, False, block_rows)), "query_id", "left")
                        .join(sampled, "query_id", "left")
                        .select("query_id", F.coalesce("neighbors", F.lit(0)).cast("long").alias("neighbors"),
                                (F.coalesce(F.col("__smax"), F.lit(1)) <= 1).alias("__complete")).where(F.col("neighbors") < k))
    settled = first.where("__complete").select("query_id", "neighbors")
    if first.where("not __complete").isEmpty():  # no cell held more rows than its witnesses
        return settled.select(F.col("query_id").alias("id"), "neighbors")
    rest = first.where("not __complete").select("query_id")
    second = rest.join(total(block_radius_counts(q.join(rest, "query_id", "left_semi"), d, keys, r, False, block_rows)), "query_id", "left") \
        .select("query_id", F.coalesce("neighbors", F.lit(0)).cast("long").alias("neighbors")).where(F.col("neighbors") < k)
    return settled.unionByName(second).select(F.col("query_id").alias("id"), "neighbors")


def snapshot_outliers_nd(points: DataFrame, radius: float, k: int, **kw) -> DataFrame:
    """O7 for vectors (or numbers): (id, neighbors) of the points with fewer
    than ``k`` neighbours within ``radius`` (exact counts)."""
    vector_col = kw.get("vector_col", "vec")
    if vector_col in points.columns and _is_vector(points, vector_col):
        return outlier_counts_nd(points, radius, k, **{c: v for c, v in kw.items() if c != "value_col"})
    return count_neighbors(points, radius, **kw).where(F.col("neighbors") < k)


__all__ = ["radius_join", "knn_join", "knn_within", "rank_by_distance", "nearest_center", "count_neighbors",
           "snapshot_outliers_nd", "distributed_rank", "choose_axes"]
