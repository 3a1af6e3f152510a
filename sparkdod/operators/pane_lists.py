"""Neighbour counts of windows of many panes, one list a value.

A rank probe for every pane makes ``4m`` rows of a value. Here the panes of one
window length (a *span*) are a group, with copies of the spans before and behind it:
three rows of a value, for any ``m``. A task sorts the values of each pane, reads the
neighbours off as one run (two binary searches, its ends moved by the exact
predicate) and gives a list of the ``m`` windows of a value in one row.

A group holds at most ``LISTED_ROWS`` values and ``LISTED_CELLS`` list entries; values of a
larger span are left to the rank probes (``neighbors.pane_range_counts``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.partitioning import materialize
from .windows import floor_div

LISTED_PANES = 8            # panes of a window from which on lists are used
LISTED_ROWS = 250_000       # values of three spans
LISTED_CELLS = 8_000_000    # values of a span times panes of a window
TILE_CELLS = 2_000_000      # of the counts that are held at once


def by_span(d: DataFrame, m: int, counted: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The distinct table (pane, value, mult[, counted]) split for ``count_lists``: rows
    (span, pane, value, mult, asked) of its groups, and the table with a column ``__ranked`` that names
    the values left to rank probes (None: no value)."""
    asked = F.lit(True) if counted is None else F.coalesce(F.col(counted), F.lit(False))
    d = d.where(F.col("pane").isNotNull()).select("pane", "value", "mult", asked.alias("asked"), floor_div(F.col("pane"), m).alias("span"))
    around = F.explode(F.array(*[F.lit(s).cast("long") for s in (-1, 0, 1)]))
    near = d.groupBy("span").agg(F.count(F.lit(1)).alias("n")).select("span", "n", around.alias("step")) \
        .groupBy((F.col("span") + F.col("step")).alias("span")) \
        .agg(F.sum("n").alias("near"), F.sum(F.when(F.col("step") == 0, F.col("n")).otherwise(0)).alias("own"))
    large = materialize(near.where((F.col("near") > LISTED_ROWS) | (F.col("own") * m > LISTED_CELLS)).select("span"))
    copies = d.select("pane", "value", "mult", "asked", "span", around.alias("step")) \
        .select((F.col("span") + F.col("step")).alias("span"), "pane", "value", "mult", (F.col("asked") & (F.col("step") == 0)).alias("asked"))
    if large.isEmpty():
        return copies, None
    ranked = d.join(large.withColumn("__large", F.lit(True)), "span", "left") \
        .select("pane", "value", "mult", (F.col("asked") & F.coalesce("__large", F.lit(False))).alias("__ranked"))
    return copies.join(large, "span", "left_anti"), ranked


def _run_ends(u: np.ndarray, v: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """First and end position of the values of ``u`` (ascending) with ``abs(u - v) <= r``."""
    n = len(u)
    lo, hi = np.searchsorted(u, v - r, "left"), np.searchsorted(u, v + r, "right")
    while True:  # fl(v - r) may be off by its rounding; the run is contiguous as fl(u - v) is monotone in u
        below = u[np.maximum(lo - 1, 0)]
        more = (lo > 0) & (np.abs(below - v) <= r)
        at = u[np.minimum(lo, n - 1)]
        less = ~more & (lo < n) & (at < v) & (np.abs(at - v) > r)
        if not (more.any() or less.any()):
            break
        lo = lo - more + less
    while True:
        above = u[np.minimum(hi, n - 1)]
        more = (hi < n) & (np.abs(above - v) <= r)
        at = u[np.maximum(hi - 1, 0)]
        less = ~more & (hi > 0) & (at > v) & (np.abs(at - v) > r)
        if not (more.any() or less.any()):
            break
        hi = hi + more - less
    return lo, np.maximum(hi, lo)


def _counts(src: np.ndarray, v: np.ndarray, panes: np.ndarray, starts: np.ndarray, u: np.ndarray, total: np.ndarray,
            r: float, m: int) -> np.ndarray:
    """Column ``j`` of row ``i``: points of pane ``src[i] - (m - 1) + j`` within ``r`` of ``v[i]``; ``src`` ascends."""
    out = np.zeros((len(src), 2 * m - 1), dtype=np.int64)
    for p, a, b in zip(panes, starts[:-1], starts[1:]):
        i, j = np.searchsorted(src, p - m + 1, "left"), np.searchsorted(src, p + m - 1, "right")
        if i < j:
            lo, hi = _run_ends(u[a:b], v[i:j], r)
            out[np.arange(i, j), p - src[i:j] + m - 1] = total[a + hi] - total[a + lo]
    return out


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))


def count_lists(copies: DataFrame, radius: float, m: int, newest: int | None = None) -> DataFrame:
    """For every value asked for (src, v, mult): ``total`` and ``before`` of its windows ``src + 1 .. src + m``
    (see ``window_neighbor_counts``), or with ``newest`` the panes of that many most recent neighbours
    up to ``src``, newest first. ``copies`` come from ``by_span``."""
    r = float(radius)
    names = ["total", "before"] if newest is None else ["newest"]

    def run(group: pa.Table) -> pa.Table:
        pane, u, mult = (group[c].to_numpy() for c in ("pane", "value", "mult"))
        asked = group["asked"].to_numpy()
        order = np.lexsort((u, pane))
        pane, u, mult, asked = pane[order], u[order], mult[order], asked[order]
        panes, first = np.unique(pane, return_index=True)
        starts, total = np.append(first, len(pane)), np.concatenate([[0], np.cumsum(mult)])
        src, v = pane[asked], u[asked]
        parts = [[] for _ in names]
        sizes = []
        step = max(1, TILE_CELLS // (2 * m))
        for i in range(0, len(src), step):
            with np.errstate(over="ignore"):
                c = _counts(src[i:i + step], v[i:i + step], panes, starts, u, total, r, m)
            if newest is None:
                run_ = np.concatenate([np.zeros((len(c), 1), dtype=np.int64), np.cumsum(c, axis=1)], axis=1)
                parts[0].append((run_[:, m:] - run_[:, :m]).ravel())
                parts[1].append((run_[:, m:m + 1] - run_[:, :m]).ravel())
                sizes.append(np.full(len(c), m))
            else:
                back = c[:, m - 1::-1].copy()      # pane src first, then backwards
                back[:, 0] -= 1                    # the point itself
                upto = np.minimum(np.cumsum(back, axis=1), newest)
                take = np.diff(upto, axis=1, prepend=0)
                labels = src[i:i + step, None] - np.arange(m)[None, :]
                parts[0].append(np.repeat(labels.ravel(), take.ravel()))
                sizes.append(upto[:, -1])
        lengths = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        lists = [_lists(np.concatenate(p) if p else np.zeros(0, dtype=np.int64), lengths) for p in parts]
        return pa.Table.from_arrays([pa.array(src, pa.int64()), pa.array(v, pa.float64()), pa.array(mult[asked], pa.int64()), *lists],
                                    names=["src", "v", "mult", *names])
    schema = "src long, v double, mult long, " + ", ".join(f"{n} array<long>" for n in names)
    return copies.groupBy("span").applyInArrow(run, schema)


def windows_of_lists(lists: DataFrame, *more: str) -> DataFrame:
    """(window, src, v, mult, total, before, more...) from (src, v, mult, total, before, more...)."""
    one = F.explode(F.transform("total", lambda t, i: F.struct((F.col("src") + i + 1).alias("window"), t.alias("t"), F.col("before")[i].alias("b"))))
    return lists.select("src", "v", "mult", *more, one.alias("w")) \
        .select("w.window", "src", "v", "mult", F.col("w.t").alias("total"), F.col("w.b").alias("before"), *more)
