"""Outliers of sliding event-time windows on a stream, listed by id.

State is kept per (value cell, pane), never per window, and its size does not
depend on how many points a cell holds. Cells are ``w`` wide, ``w`` the largest
power of two not above ``R``: dividing by it is exact, so members of one cell are
neighbours of each other at any magnitude. Hence

* a cell with more than ``k`` points in a window holds inliers only; a pane's ids
  are kept while there are at most ``k`` of them;
* a point of any other cell counts its own cell whole, and of the two cells on
  either side the values in reach. Those are the smallest values of a cell
  to the right and the largest of one to the left, so the nearest ``k + 1`` of a
  pane decide whether it has ``k`` neighbours, and how many if it has fewer.

A task first condenses its rows to such summaries (``mapInPandas``, no shuffle), so a
hot cell, or a value range narrower than ``R`` with any number of values in it,
reaches its state as a few short lists. ``transformWithState`` merges them into map
state (pane, side), and event-time timers at the window ends count, emit and evict:
a point is stored and condensed once, not once for each of its ``m`` windows, and
no bounds are taken from the data beforehand.
"""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.neighbors import check_radius
from ..operators.windows import Windows
from ..session import scratch_path

# fixed value: the reference's out-of-orderness (1000 ms) plus allowed lateness (1000 ms)
DEFAULT_DELAY = "2 seconds"
# the marker row that closes the last windows of a bounded input
END_OF_INPUT = _dt.datetime(9000, 1, 1)
SUMMARY = "cell double, pane long, side int, n long, ids array<long>, vals array<double>, t long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cell_width(radius: float) -> float:
    """The largest power of two not above the radius (0 for radius 0)."""
    return math.ldexp(0.5, math.frexp(radius)[1]) if radius > 0 else 0.0


def cells_of(values: np.ndarray, width: float) -> np.ndarray:
    """Cell number as DOUBLE: exact at any magnitude. Without a width each value is its own cell."""
    if not width:
        return values + 0.0
    with np.errstate(over="ignore"):
        cells = np.floor(values / width)
    return np.where(np.isfinite(cells), cells, values) + 0.0


def summaries(pdf: pd.DataFrame, slide: int, width: float, k: int) -> pd.DataFrame:
    """One row for each (pane, cell) of ``id, value, t`` (microseconds) and each cell whose points it may
    concern: the number of points and, for the cell itself (side 0), the ids and values of up to ``k``
    points; for cells on its left (side 1) the ``k + 1`` smallest values, on its right (side -1) the largest."""
    usable = np.isfinite(pdf["value"].to_numpy(float, na_value=np.nan))
    out, moment = [], pdf["t"].dropna()
    if not usable.all() and len(moment):  # no points, but their time passes
        out.append((0.0, 0, 0, 0, [], [], int(moment.max())))
    pdf = pdf[usable]
    value, t = pdf["value"].to_numpy(float), pdf["t"].to_numpy(np.int64)
    pane, cell = t // slide, cells_of(value, width)
    order = np.lexsort((value, cell, pane))
    value, t, pane, cell, ids = value[order], t[order], pane[order], cell[order], pdf["id"].to_numpy()[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(pane) != 0) | (np.diff(cell) != 0)])) if len(value) else []
    for s, e in zip(starts, [*starts[1:], len(value)]):
        c, p, last = float(cell[s]), int(pane[s]), int(t[s:e].max())
        few = e - s <= k
        out.append((c, p, 0, int(e - s), ids[s:e].tolist() if few else [], value[s:e].tolist() if few else [], last))
        low, high = value[s:e][:k + 1].tolist(), value[s:e][-k - 1:].tolist()
        for target in {c - 2, c - 1} - {c} if width else ():
            out.append((target, p, 1, int(e - s), [], low, last))
        for target in {c + 1, c + 2} - {c} if width else ():
            out.append((target, p, -1, int(e - s), [], high, last))
    return pd.DataFrame(out, columns=["cell", "pane", "side", "n", "ids", "vals", "t"])


def merge(a: tuple, b: tuple, side: int, k: int) -> tuple[int, list, list]:
    """Two summaries (n, ids, vals) of one pane and side as one."""
    n = a[0] + b[0]
    if side == 0:
        return (n, [*a[1], *b[1]], [*a[2], *b[2]]) if n <= k else (n, [], [])
    vals = sorted([*a[2], *b[2]])
    return n, [], vals[:k + 1] if side > 0 else vals[-k - 1:]


def outliers_of(own: list[tuple], near: list[tuple], radius: float, k: int) -> list[tuple[int, float, int]]:
    """``id, value, neighbors`` of a cell's outliers in one window, from the summaries of its panes."""
    total = sum(n for n, _, _ in own)
    if total > k:
        return []
    values = np.array([v for _, _, vals in own for v in vals], float)
    ids = [i for _, i_s, _ in own for i in i_s]
    others = np.sort(np.array([v for _, _, vals in near for v in vals], float))
    found = np.full(len(values), total - 1)
    for i, v in enumerate(values):
        found[i] += int((np.abs(others - v) <= radius).sum())
    return [(int(i), float(v), int(f)) for i, v, f in zip(ids, values, found) if f < k]


class WindowOutliers(StatefulProcessor):
    """Keeps the summaries of a value cell and of what its neighbours send, pane by pane."""

    def __init__(self, radius: float, k: int, panes: int, slide_ms: int, listed: bool):
        self.radius, self.k, self.m, self.slide_ms, self.listed = radius, k, panes, slide_ms, listed

    def init(self, handle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane long, side int", "n long, ids array<long>, vals array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[tuple[int, int], tuple] = {}
        for r in rows:
            if r.n:
                at, one = (r.pane, r.side), (r.n, r.ids, r.vals)
                new[at] = merge(new[at], one, r.side, self.k) if at in new else one
        for (pane, side), one in new.items():
            if self.panes.containsKey((pane, side)):
                one = merge(tuple(self.panes.getValue((pane, side))), one, side, self.k)
            elif side == 0:
                for e in range(pane + 1, pane + self.m + 1):
                    self.handle.registerTimer(e * self.slide_ms)
            else:
                self.handle.registerTimer((pane + self.m) * self.slide_ms)  # evicts
            self.panes.updateValue((pane, side), one)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs() // self.slide_ms
        own, near, gone = [], [], []
        for at, summary in self.panes.iterator():
            pane, side = at[0], at[1]
            if end - self.m <= pane < end:
                (near if side else own).append(tuple(summary))
            if pane <= end - self.m:
                gone.append((pane, side))
        for at in gone:
            self.panes.removeKey(at)
        if not own:
            return
        found = outliers_of(own, near, self.radius, self.k)
        if self.listed:
            for i, v, f in found:
                yield Row(window=end, id=i, value=v, neighbors=f)
        else:
            yield Row(window=end, outliers=len(found))

    def close(self) -> None:
        pass


def stream_window_outliers(points: DataFrame, size, slide, radius: float, k: int, *, id_col: str = "id", ts_col: str = "ts",
                           value_col: str = "value", delay: str = DEFAULT_DELAY, listed: bool = True) -> DataFrame:
    """O2 on a streaming DataFrame: ``(window_end, id, value, neighbors)`` of every outlier once the watermark
    passes its window. With ``listed=False`` one row for each (window, value cell) with points:
    ``(window_end, outliers)``, to be added up per window (all cells of a window come in one micro-batch).

    The slide divides the size and is a whole number of milliseconds. NULL, NaN and infinite values are no
    points (D5). Rows up to ``delay`` late count; later ones are dropped, at the latest when
    their pane is over (before, one may still count with a newer row of its task and cell).
    Needs the RocksDB state store."""
    radius = check_radius(radius)
    w = Windows.time(size, slide, ts_col)
    if w.panes_per_window is None or w.slide % 1000:
        raise ValueError("the slide must divide the window size and be whole milliseconds")
    width, slide_us = cell_width(radius), w.slide

    def condense(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield summaries(pdf, slide_us, width, k)

    plain = points.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).cast("double").alias("value"), w.position(points).alias("t"))
    condensed = plain.where("t is not null").mapInPandas(condense, SUMMARY).withColumn("t", F.timestamp_micros("t")).withWatermark("t", delay)
    schema = "window long, id long, value double, neighbors long" if listed else "window long, outliers long"
    found = condensed.groupBy("cell").transformWithState(
        WindowOutliers(radius, k, w.panes_per_window, slide_us // 1000, listed), schema, "Append", "EventTime")
    return found.select(w.label(F.col("window"), points).alias("window_end"), *[c for c in found.columns if c != "window"])


def run_to_end(spark: SparkSession, path: str, build, out_schema_of, *, ts_col: str, flush: bool, files_per_batch: int | None, combine=None, step=None) -> DataFrame:
    """Run ``build(stream)`` over the parquet file(s) at ``path`` until all input is processed and return the
    emitted rows as a table. Each micro-batch is written to a folder of its own number, so one that is
    repeated after a failure replaces itself. ``combine`` works on the rows of one micro-batch, ``step`` on
    its rows and number (they are computed once).

    State, the end marker and the emitted rows live in the shared checkpoint folder. Only the schema is read beforehand."""
    schema = spark.read.parquet(path).schema
    src = path if not path.endswith(".parquet") else path[:-1] + "[t]"  # a glob: the source wants a folder
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    marker, out = scratch_path(spark, "stream-end-marker"), scratch_path(spark, "stream-result")
    spark.createDataFrame([], schema).write.parquet(marker)
    result = build(reader.parquet(src).unionByName(spark.readStream.schema(schema).parquet(marker)))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, number: int) -> None:
        if step:
            batch.persist()
        try:
            rows = step(batch, number) if step else combine(batch) if combine else batch
            rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            if step:
                batch.unpersist()

    try:
        query = result.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", scratch_path(spark, "stream-state")).start()
    finally:  # the running query has its own copy of the settings
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    try:
        query.processAllAvailable()
        if flush:
            row = {f.name: None for f in schema.fields} | {ts_col: END_OF_INPUT}
            spark.createDataFrame([row], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])).write.mode("append").parquet(marker)
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(out_schema_of(result)).parquet(out).drop("batch")


def run_stream_window_outliers(spark: SparkSession, path: str, size, slide, radius: float, k: int, *, id_col: str = "id", ts_col: str = "ts",
                               value_col: str = "value", flush: bool = True, delay: str = DEFAULT_DELAY, files_per_batch: int | None = None) -> DataFrame:
    """O2 over a file stream until its end: ``(window_end, id, value, neighbors)`` as a table."""
    return run_to_end(spark, path, lambda s: stream_window_outliers(s, size, slide, radius, k, id_col=id_col, ts_col=ts_col, value_col=value_col, delay=delay),
                      lambda r: r.schema, ts_col=ts_col, flush=flush, files_per_batch=files_per_batch)


def run_stream_window_counts(spark: SparkSession, path: str, size, slide, radius: float, k: int, *, id_col: str = "id", ts_col: str = "ts",
                             value_col: str = "value", flush: bool = True, delay: str = DEFAULT_DELAY, files_per_batch: int | None = None) -> DataFrame:
    """O6 over a file stream until its end: ``(window_end, outliers)`` as a table, from the same state."""
    return run_to_end(spark, path, lambda s: stream_window_outliers(s, size, slide, radius, k, id_col=id_col, ts_col=ts_col, value_col=value_col, delay=delay, listed=False),
                      lambda r: r.schema, ts_col=ts_col, flush=flush, files_per_batch=files_per_batch,
                      combine=lambda b: b.groupBy("window_end").agg(F.sum("outliers").alias("outliers")))
