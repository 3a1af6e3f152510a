"""Blockwise distance evaluation for high-dimensional candidates.

In high dimensions distances concentrate and no lower bound prunes much, so
candidate pairs must be evaluated in bulk. Spark evaluates a 64-term
distance per joined row through interpreted array functions; here the
candidates of one grid cell are evaluated as a block with numpy inside
``cogroup().applyInPandas``: each vector crosses the Arrow boundary once
per block, not once per pair, and only pairs within the radius are
emitted.

A cell that holds more than ``block_rows`` rows on a side is hash-split into
chunks of about that size, so a hot cell becomes many bounded tasks instead of
one unbounded group. A vector is shipped once for each chunk of the other
side; inside a task a block is evaluated in tiles of ``TILE_ROWS``, which is
what bounds the distance matrices.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BLOCK_ROWS = 20_480
TILE_ROWS = 2_048
FIRST_TILE = 64          # objects that queries meet first where the nearest are asked for


def _tiled(qdf: pd.DataFrame, ddf: pd.DataFrame, evaluate) -> pd.DataFrame:
    """``evaluate`` on every pair of tiles of the two sides."""
    parts = [evaluate(qdf.iloc[i:i + TILE_ROWS].reset_index(drop=True), ddf.iloc[j:j + TILE_ROWS].reset_index(drop=True))
             for i in range(0, max(1, len(qdf)), TILE_ROWS) for j in range(0, max(1, len(ddf)), TILE_ROWS)]
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def _matrix(vectors: pd.Series) -> tuple[np.ndarray | None, np.ndarray]:
    lengths = vectors.map(len).to_numpy()
    if len(lengths) and (lengths == lengths[0]).all():
        return np.concatenate(vectors.to_numpy()).astype(np.float64).reshape(len(lengths), lengths[0]), lengths
    return None, lengths


def _sq_dist(q: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Squared distances over the first ``n`` coordinates, summed left to
    right (the order of the SQL definition, so results are bit-identical)."""
    acc = np.zeros((q.shape[0], d.shape[0]))
    for i in range(n):
        diff = q[:, i:i + 1] - d[None, :, i]
        acc += diff * diff
    return acc


def block_distances(qv: pd.Series, dv: pd.Series) -> np.ndarray:
    """Distance matrix with the shorter-prefix rule for ragged vectors."""
    qm, ql = _matrix(qv)
    dm, dl = _matrix(dv)
    if qm is not None and dm is not None:
        n = min(qm.shape[1], dm.shape[1])
        if n == 1:  # numbers: abs(a - b), the 1-D definition
            return np.abs(qm[:, :1] - dm[None, :, 0])
        return np.sqrt(_sq_dist(qm, dm, n))
    out = np.empty((len(qv), len(dv)))
    qa = [np.asarray(v, dtype=np.float64) for v in qv.to_numpy()]
    da = [np.asarray(v, dtype=np.float64) for v in dv.to_numpy()]
    for lq in np.unique(ql):
        qi = np.nonzero(ql == lq)[0]
        for ld in np.unique(dl):
            di = np.nonzero(dl == ld)[0]
            n = int(min(lq, ld))
            qm2 = np.stack([qa[i][:n] for i in qi]) if n else np.zeros((len(qi), 0))
            dm2 = np.stack([da[i][:n] for i in di]) if n else np.zeros((len(di), 0))
            out[np.ix_(qi, di)] = np.sqrt(_sq_dist(qm2, dm2, n))
    return out


# Bound on |matmul-form squared distance - exact squared distance|, relative
# to |x|^2 + |y|^2 (float64, a few hundred terms): far above the rounding.
_APPROX_REL_ERR = 2.0 ** -40


class _Block:
    """Exact radius decisions and distances for a query block against a data
    block. The BLAS form ``|x|^2 + |y|^2 - 2 x.y`` only *selects* candidates
    (with an error margin); every distance that decides or is emitted is the
    exact left-to-right sum, as in SQL."""

    def __init__(self, qv: pd.Series, dv: pd.Series):
        self.qm, _ = _matrix(qv)
        self.dm, _ = _matrix(dv)
        self.ragged = self.qm is None or self.dm is None
        if self.ragged:
            self.full = block_distances(qv, dv)
            return
        self.n = min(self.qm.shape[1], self.dm.shape[1])
        q, d = self.qm[:, :self.n], self.dm[:, :self.n]
        qn, dn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", d, d)
        if self.n == 1:
            self.full = np.abs(q[:, :1] - d[None, :, 0])
            return
        self.full = None
        # |x|^2 + |y|^2 - 2 x.y in one product; the margin is one number a row
        one = np.ones
        self.d2 = np.column_stack([-2.0 * q, qn, one(len(q))]) @ np.column_stack([d, one(len(d)), dn]).T
        self.err = ((qn + dn.max(initial=0.0)) * _APPROX_REL_ERR + 1e-300)[:, None]

    def exact(self, qi: np.ndarray, dj: np.ndarray) -> np.ndarray:
        if self.full is not None:
            return self.full[qi, dj]
        acc = np.zeros(len(qi))
        for t in range(self.n):
            diff = self.qm[qi, t] - self.dm[dj, t]
            acc += diff * diff
        return np.sqrt(acc)

    def within(self, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query index, data index, exact distance) with distance <= r."""
        if self.full is not None:
            qi, dj = np.nonzero(self.full <= r)
            return qi, dj, self.full[qi, dj]
        maybe = self.d2 <= r * r * (1 + 1e-12) + self.err
        qi, dj = np.nonzero(maybe)
        dist = self.exact(qi, dj)
        keep = dist <= r
        return qi[keep], dj[keep], dist[keep]


def _decided(blk: _Block, r: float, same: np.ndarray | None) -> np.ndarray:
    """Boolean matrix: exact distance <= r (self pairs removed when ``same``).
    Pairs surely inside by the margin skip the exact sum; only the thin band
    around r is computed exactly."""
    if blk.full is not None:
        inside = blk.full <= r
    else:
        r2 = r * r
        inside = blk.d2 <= r2 * (1 - 1e-12) - blk.err
        band = (blk.d2 <= r2 * (1 + 1e-12) + blk.err) & ~inside
        qi, dj = np.nonzero(band)
        if len(qi):
            inside[qi, dj] = blk.exact(qi, dj) <= r
    if same is not None:
        inside &= ~same
    return inside


def _topk_within(blk: _Block, inside: np.ndarray, did: np.ndarray, k: int):
    """Per row the k objects of ``inside`` with the smallest exact distance
    (ties by id): (row index, column index, exact distance), rows ascending.
    Exact sums only for candidates within twice the error margin of the
    row's approximate k-th value, which contain every true top-k object."""
    if blk.full is not None:
        masked = np.where(inside, blk.full, np.inf)
        top = _row_topk(masked, did, k)
        dtop = np.take_along_axis(masked, top, axis=1)
        valid = np.isfinite(dtop)
        rows = np.broadcast_to(np.arange(inside.shape[0])[:, None], top.shape)[valid]
        return rows, top[valid], dtop[valid]
    cand = inside
    if np.count_nonzero(inside) > 4 * k * len(inside):
        approx = np.where(inside, blk.d2, np.inf)
        n = approx.shape[1]
        kk = min(k, n)
        kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1] if kk < n else approx.max(axis=1)
        kth = np.where(np.isfinite(kth), kth, np.inf)
        margin = 2.0 * blk.err.max(axis=1)
        cand = inside & (approx <= (kth + margin)[:, None])
    qi, dj = np.nonzero(cand)
    dist = blk.exact(qi, dj)
    order = np.lexsort((did[dj], dist, qi))
    qi, dj, dist = qi[order], dj[order], dist[order]
    starts = np.searchsorted(qi, qi, side="left")
    keep = (np.arange(len(qi)) - starts) < k
    return qi[keep], dj[keep], dist[keep]


def _block_topk(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The tiles' lists of a block as one list of ``k`` a query, its count on the first row."""
    found = found.sort_values(["query_id", "distance", "neighbor_id"], kind="stable", ignore_index=True)
    place = found.groupby("query_id").cumcount()
    found["n"] = found.groupby("query_id")["n"].transform("sum").where(place == 0, 0)
    return found[place < k]


def _keep_nearest(best: np.ndarray, at: np.ndarray, rows: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], start: int, order: np.ndarray) -> None:
    """Put ``pairs`` of ``rows`` and objects (``start``, ``start + 1``, ...) into the rows' nearest ones so far:
    ``best`` distances, ascending, and ``at`` the objects' positions; ties by ``order``."""
    need, (hit, col, near) = best.shape[1], pairs
    if not len(hit):
        return
    old, place = np.nonzero(np.isfinite(best[rows]) & np.isin(np.arange(len(rows)), hit)[:, None])
    row = np.concatenate([old, hit])
    dist = np.concatenate([best[rows[old], place], near])
    pos = np.concatenate([at[rows[old], place], col + start])
    turn = np.lexsort((order[pos], dist, row))
    row, dist, pos = row[turn], dist[turn], pos[turn]
    rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    row, dist, pos, rank = (x[rank < need] for x in (row, dist, pos, rank))
    best[rows[row], rank], at[rows[row], rank] = dist, pos


def _padded(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and their lengths."""
    matrix, lengths = _matrix(vectors)
    if matrix is None:
        matrix = np.zeros((len(lengths), lengths.max(initial=0)))
        for n in np.unique(lengths[lengths > 0]):
            matrix[lengths == n, :n] = np.array([np.asarray(v, dtype=np.float64) for v in vectors[lengths == n]]).reshape(-1, n)
    return matrix, lengths


def _prefix_squares(q: np.ndarray, ql: np.ndarray, d: np.ndarray, dl: np.ndarray) -> np.ndarray:
    """About the squared distances over the shorter prefix, one product for every pair of lengths; both sides ascend in length."""
    out = np.empty((len(q), len(d)))
    for n in np.unique(ql):
        a, b = np.searchsorted(ql, [n, n + 1])
        for m in np.unique(dl):
            c, e = np.searchsorted(dl, [m, m + 1])
            w = min(n, m)
            x, y = q[a:b, :w], d[c:e, :w]
            one = np.ones
            np.matmul(np.column_stack([-2.0 * x, np.einsum("ij,ij->i", x, x), one(b - a)]),
                      np.column_stack([y, one(e - c), np.einsum("ij,ij->i", y, y)]).T, out=out[a:b, c:e])
    return out


def _prefix_distances(q: np.ndarray, ql: np.ndarray, d: np.ndarray, dl: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of pairs over the shorter prefix, summed left to right."""
    width = np.minimum(ql[rows], dl[cols])
    turn = np.argsort(-width, kind="stable")
    rows, cols, ends = rows[turn], cols[turn], np.searchsorted(-width[turn], -np.arange(width.max(initial=0)), side="left")
    sums = np.zeros(len(turn))
    for t, n in enumerate(ends):  # the pairs that have a value at this place come first
        diff = q[rows[:n], t] - d[cols[:n], t]
        sums[:n] += diff * diff
    out = np.empty(len(turn))
    out[turn] = np.sqrt(sums)
    return out


def _block_nearest(qdf: pd.DataFrame, ddf: pd.DataFrame, r: float, k: int, include_self: bool) -> pd.DataFrame | None:
    """The ``k`` nearest objects within ``r`` of every query row of a block, ties by id: (query_id, neighbor_id, distance, n = 1). The nearest
    so far bound those that follow. None where squares are too large for a product."""
    qdf, ddf = (x.iloc[np.argsort(x[c].map(len).to_numpy(), kind="stable")] for x, c in ((qdf, "qvec"), (ddf, "dvec")))
    (qm, ql), (dm, dl) = _padded(qdf["qvec"]), _padded(ddf["dvec"])
    with np.errstate(over="ignore"):
        qn, dn = np.einsum("ij,ij->i", qm, qm), np.einsum("ij,ij->i", dm, dm)
        if not qn.max() + dn.max() < 1e300:
            return None
    qid, did = qdf["query_id"].to_numpy().astype("int64"), ddf["neighbor_id"].to_numpy().astype("int64")
    parts = []
    for i in range(0, len(qid), TILE_ROWS):
        at_rows = slice(i, i + TILE_ROWS)
        q, n = qm[at_rows], ql[at_rows]
        best, at, every = np.full((len(q), k), np.inf), np.zeros((len(q), k), dtype=np.int64), np.arange(len(q))
        j, size = 0, FIRST_TILE
        while j < len(did):
            d, m = dm[j:j + size], dl[j:j + size]
            bound = np.minimum(r, best[:, -1])
            with np.errstate(over="ignore"):
                most = bound * bound * (1 + 1e-12) + (qn[at_rows] + dn[j:j + size].max()) * _APPROX_REL_ERR + 1e-300
            rows, cols = np.nonzero(_prefix_squares(q, n, d, m) <= most[:, None])
            if not include_self:
                other = qid[at_rows][rows] != did[j:j + size][cols]
                rows, cols = rows[other], cols[other]
            dist = _prefix_distances(q, n, d, m, rows, cols)
            near = dist <= bound[rows]
            _keep_nearest(best, at, every, (rows[near], cols[near], dist[near]), j, did)
            j, size = j + size, min(4 * size, TILE_ROWS)
        rows, cols = np.nonzero(np.isfinite(best))
        parts.append(pd.DataFrame({"query_id": qid[at_rows][rows], "neighbor_id": did[at[rows, cols]], "distance": best[rows, cols], "n": 1}))
    return pd.concat(parts, ignore_index=True)


def _row_topk(masked: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the ``k`` smallest entries per row, ordered by
    (value, id). Linear-time selection; only rows with a tie at the k-th
    value are fully sorted (ties are broken by id)."""
    m, n = masked.shape
    k = min(k, n)
    if k == 0:
        return np.zeros((m, 0), dtype=np.int64)
    if k < n:
        part = np.argpartition(masked, k - 1, axis=1)[:, :k]
    else:
        part = np.broadcast_to(np.arange(n)[None, :], (m, n)).copy()
    vals = np.take_along_axis(masked, part, axis=1)
    order = np.lexsort((ids[part], vals), axis=-1)
    top = np.take_along_axis(part, order, axis=1)
    kth = np.take_along_axis(vals, order, axis=1)[:, -1]
    tied = np.isfinite(kth) & ((masked <= kth[:, None]).sum(axis=1) > k)
    if tied.any():
        full = np.lexsort((np.broadcast_to(ids[None, :], (int(tied.sum()), n)), masked[tied]), axis=-1)[:, :k]
        top[tied] = full
    return top


def _chunked(q: DataFrame, d: DataFrame, keys: list[str], block_rows: int):
    """Hash-split every key group into chunks of at most ``block_rows`` rows
    per side; a query chunk meets every data chunk of its key."""
    b = int(block_rows)
    qn = q.groupBy(*keys).agg(F.count(F.lit(1)).alias("__qn"))
    dn = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__dn"))
    sizes = qn.join(dn, keys).select(*keys, F.ceil(F.col("__qn") / b).cast("long").alias("__cq"),
                                     F.ceil(F.col("__dn") / b).cast("long").alias("__cd"))
    q2 = q.join(sizes, keys).select(
        *q.columns, F.pmod(F.xxhash64("query_id"), F.col("__cq")).alias("__kq"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("__cd") - 1)).alias("__kd"))
    d2 = d.join(sizes, keys).select(
        *d.columns, F.pmod(F.xxhash64("neighbor_id"), F.col("__cd")).alias("__kd"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("__cq") - 1)).alias("__kq"))
    return q2, d2, keys + ["__kq", "__kd"]


def block_radius_counts(q: DataFrame, d: DataFrame, keys: Sequence[str], radius: float, include_self: bool,
                        block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Like ``block_radius_pairs`` but every block emits one partial count per
    query, never the pairs: output grows with the queries, not with the
    pairs, even inside a dense cluster. Returns (query_id, cnt) partials to
    be summed per query."""
    r = float(radius)
    q2, d2, gkeys = _chunked(q.select(*keys, "query_id", "qvec"), d.select(*keys, "neighbor_id", "dvec"),
                             list(keys), block_rows)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("cnt", T.LongType())])

    def evaluate(qdf: pd.DataFrame, ddf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or ddf.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "cnt": pd.Series(dtype="int64")})
        qid = qdf["query_id"].to_numpy().astype("int64")
        did = ddf["neighbor_id"].to_numpy().astype("int64")
        same = qid[:, None] == did[None, :] if not include_self and np.isin(did, qid).any() else None
        inside = _decided(_Block(qdf["qvec"], ddf["dvec"]), r, same)
        return pd.DataFrame({"query_id": qid, "cnt": inside.sum(axis=1).astype("int64")})

    def run(qdf, ddf):
        return _tiled(qdf, ddf, evaluate)

    return q2.groupBy(*gkeys).cogroup(d2.groupBy(*gkeys)).applyInPandas(run, schema)


def block_radius_pairs(q: DataFrame, d: DataFrame, keys: Sequence[str], radius: float, include_self: bool,
                       passthrough: Sequence[str] = (), block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Pairs within ``radius`` of ``q`` (query_id, qvec, keys) and ``d``
    (neighbor_id, dvec, keys) that share all ``keys``.

    Returns (query_id, neighbor_id, distance, *passthrough) where
    ``passthrough`` are key columns to keep in the output."""
    keys = list(keys)
    r = float(radius)
    q2, d2, gkeys = _chunked(q.select(*keys, "query_id", "qvec"), d.select(*keys, "neighbor_id", "dvec"),
                             keys, block_rows)
    keep = list(passthrough)
    schema_fields = [T.StructField("query_id", T.LongType()), T.StructField("neighbor_id", T.LongType()),
                     T.StructField("distance", T.DoubleType())]
    q_schema = {f.name: f.dataType for f in q.schema.fields}
    schema_fields += [T.StructField(c, q_schema[c]) for c in keep]
    schema = T.StructType(schema_fields)
    key_pos = {c: gkeys.index(c) for c in keep}

    def evaluate(key, qdf: pd.DataFrame, ddf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or ddf.empty:
            return pd.DataFrame({f.name: pd.Series(dtype="float64" if f.name == "distance" else "int64")
                                 for f in schema_fields})
        qi, di, dist = _Block(qdf["qvec"], ddf["dvec"]).within(r)
        qids = qdf["query_id"].to_numpy().astype("int64")[qi]
        dids = ddf["neighbor_id"].to_numpy().astype("int64")[di]
        if not include_self:
            mask = qids != dids
            qids, dids, dist = qids[mask], dids[mask], dist[mask]
        out = pd.DataFrame({"query_id": qids, "neighbor_id": dids, "distance": dist})
        for c in keep:
            out[c] = key[key_pos[c]]
        return out

    def run(key, qdf, ddf):
        return _tiled(qdf, ddf, lambda q_tile, d_tile: evaluate(key, q_tile, d_tile))

    return q2.groupBy(*gkeys).cogroup(d2.groupBy(*gkeys)).applyInPandas(run, schema)


def block_radius_topk(q: DataFrame, d: DataFrame, keys: Sequence[str], radius: float, k: int,
                      include_self: bool, block_rows: int = DEFAULT_BLOCK_ROWS, counts: bool = True) -> DataFrame:
    """Per block and query: the ``k`` nearest objects within ``radius`` (ties
    by object id) and how many objects lie within ``radius``.

    Returns (query_id, neighbor_id, distance, n) where ``n`` is the block's
    count for the query on its first row and 0 on the others, so
    ``sum(n)`` per query is the query's total count. The global ``k``
    nearest are the ``k`` nearest of these partial lists, so a dense cluster
    never emits more than ``k`` rows per query and block. Without ``counts`` an ``n`` may be short where it is ``k`` or
    more, and objects beyond the nearest so far are passed over."""
    r = float(radius)
    kk = int(k)
    q2, d2, gkeys = _chunked(q.select(*keys, "query_id", "qvec"), d.select(*keys, "neighbor_id", "dvec"),
                             list(keys), block_rows)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("neighbor_id", T.LongType()),
                           T.StructField("distance", T.DoubleType()), T.StructField("n", T.LongType())])

    def evaluate(qdf: pd.DataFrame, ddf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "neighbor_id": pd.Series(dtype="int64"),
                              "distance": pd.Series(dtype="float64"), "n": pd.Series(dtype="int64")})
        if qdf.empty or ddf.empty:
            return empty
        qid = qdf["query_id"].to_numpy().astype("int64")
        did = ddf["neighbor_id"].to_numpy().astype("int64")
        same = qid[:, None] == did[None, :] if not include_self and np.isin(did, qid).any() else None
        blk = _Block(qdf["qvec"], ddf["dvec"])
        inside = _decided(blk, r, same)
        counts = inside.sum(axis=1)
        rows, cols, dist = _topk_within(blk, inside, did, kk)
        if len(rows) == 0:
            return empty
        first = np.r_[True, rows[1:] != rows[:-1]]
        return pd.DataFrame({"query_id": qid[rows], "neighbor_id": did[cols], "distance": dist,
                             "n": np.where(first, counts[rows], 0).astype("int64")})

    def run(qdf, ddf):
        nearest = _block_nearest(qdf, ddf, r, kk, include_self) if not counts and kk > 0 and len(qdf) and len(ddf) else None
        return _block_topk(_tiled(qdf, ddf, evaluate) if nearest is None else nearest, kk)

    return q2.groupBy(*gkeys).cogroup(d2.groupBy(*gkeys)).applyInPandas(run, schema)
