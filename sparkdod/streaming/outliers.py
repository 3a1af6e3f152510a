"""Continuous outlier counts with Structured Streaming.

Plan, all stateful steps are windowed aggregations whose state the
watermark evicts (append mode, one final result per window, D2)::

    points -> withWatermark(ts, delay)          W2, W5: delay + allowed lateness
           -> replicate to value cells          R1, R2 (bounds fixed at start)
           -> groupBy(window, cell, value)      duplicates collapse to a count
           -> groupBy(window, cell)             values of one cell as arrays
              + vectorised count per cell       pandas UDF: sort + binary search
           -> groupBy(window) sum               A5 (chained aggregation)

A cell holds about ``1 / cells`` of a window's distinct values, so no state
group grows with the whole window. Bounds closer than ``R`` are merged, so a
point is copied to at most three cells; a value range narrower than ``R``
that holds many distinct values stays one group (the batch form has no
such group). Spark closes a window only when the
watermark passes it; at the end of a bounded input ``flush=True`` appends
one marker row far in the future so the last windows close too (W9). The
marker sits in its own windows, which never close, so it is never counted.
"""

from __future__ import annotations

import datetime as _dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cells import ROUNDING_SLACK, merge_narrow_bounds, quantile_bounds, replicate
from ..session import scratch_path, shuffle_partitions
from ..operators.windows import Windows

# fixed value: the reference's out-of-orderness (1000 ms) plus allowed lateness (1000 ms)
DEFAULT_DELAY = "2 seconds"
_FAR_FUTURE = _dt.datetime(9000, 1, 1)
ROWS_PER_STREAM_CELL = 200_000


def neighbour_totals(values: np.ndarray, mults: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact ``#{u : abs(u - v) <= R}`` (with multiplicity) for every value.

    Sorted values + binary search for the bulk; values within the rounding
    slack of ``v +- R`` are checked with the exact predicate, all at once.
    Returns (order, totals in sorted order)."""
    order = np.argsort(values, kind="stable")
    x = values[order].astype(np.float64)
    w = mults[order].astype(np.int64)
    cum = np.concatenate([[0], np.cumsum(w)])
    r = float(radius)
    slack = (np.abs(x) + r) * ROUNDING_SLACK
    lo_in = np.searchsorted(x, x - r + slack, "left")
    hi_in = np.searchsorted(x, x + r - slack, "right")
    lo_out = np.searchsorted(x, x - r - slack, "left")
    hi_out = np.searchsorted(x, x + r + slack, "right")
    empty = hi_in <= lo_in
    lo_in = np.where(empty, hi_out, lo_in)
    hi_in = np.where(empty, hi_out, hi_in)
    tot = cum[hi_in] - cum[lo_in]
    for first, last in ((lo_out, lo_in), (hi_in, hi_out)):
        width = np.maximum(last - first, 0)
        row = np.repeat(np.arange(len(x)), width)
        near = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
        hit = np.abs(x[near] - x[row]) <= r
        np.add.at(tot, row[hit], w[near[hit]])
    return order, tot


def _cell_outlier_udf(radius: float, k: int):
    @F.pandas_udf(T.LongType())
    def cell_outliers(values: pd.Series, mults: pd.Series, owners: pd.Series) -> pd.Series:
        out = np.zeros(len(values), dtype=np.int64)
        for n, (v, m, o) in enumerate(zip(values, mults, owners)):
            v = np.asarray(v, dtype=np.float64)
            if v.size == 0:
                continue
            m = np.asarray(m, dtype=np.int64)
            o = np.asarray(o, dtype=bool)
            order, tot = neighbour_totals(v, m, radius)
            own = o[order]
            out[n] = int(m[order][own & (tot - 1 < k)].sum())
        return pd.Series(out)
    return cell_outliers


def stream_outlier_counts(points: DataFrame, size, slide, radius: float, k: int, bounds, *,
                          ts_col: str = "ts", value_col: str = "value", delay: str = DEFAULT_DELAY) -> DataFrame:
    """O6 on a streaming DataFrame of points: (window_end, outliers), one row
    per window once the watermark passes its end. ``window_end`` has the type
    of ``ts_col`` (NTZ input -> NTZ output)."""
    w = Windows.time(size, slide, ts_col)
    ntz = isinstance(points.schema[ts_col].dataType, T.TimestampNTZType)
    # NTZ wall clock -> the instant with the same epoch microseconds, so window
    # bounds do not depend on the session time zone (same as the batch form)
    t = F.timestamp_micros(w.position(points)) if ntz else F.col(ts_col)
    p = points.select(t.alias("__t"), F.col(value_col).cast("double").alias("value")) \
        .where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))) \
        .withWatermark("__t", delay)
    p = replicate(p, "value", bounds, radius)
    size_s, slide_s = f"{w.size} microseconds", f"{w.slide} microseconds"
    distinct = p.groupBy(F.window("__t", size_s, slide_s).alias("window"), "cell", "value", "is_replica") \
        .agg(F.count(F.lit(1)).alias("mult"))
    per_cell = distinct.groupBy("window", "cell").agg(
        F.collect_list("value").alias("vals"), F.collect_list("mult").alias("mults"),
        F.collect_list(~F.col("is_replica")).alias("owners"))
    per_cell = per_cell.select("window", _cell_outlier_udf(radius, k)("vals", "mults", "owners").alias("outliers"))
    per_window = per_cell.groupBy("window").agg(F.sum("outliers").cast("long").alias("outliers"))
    end = F.col("window.end")
    if ntz:
        end = F.timestamp_add("MICROSECOND", F.unix_micros(end), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return per_window.select(end.alias("window_end"), "outliers")


def run_stream_outlier_counts(spark: SparkSession, path: str, size, slide, radius: float, k: int, *,
                              ts_col: str = "ts", value_col: str = "value", cells: int | None = None,
                              flush: bool = True, delay: str = DEFAULT_DELAY,
                              files_per_batch: int | None = None) -> DataFrame:
    """Run O6 over the parquet file(s) at ``path`` as a file stream until all
    input is processed and return the emitted rows as a table.

    Cell bounds come from the static table (the stream's value distribution
    at start). State, the end marker and the emitted rows live in the shared
    checkpoint folder. ``files_per_batch`` cuts the input into micro-batches;
    the marker is delivered after the last of them."""
    static = spark.read.parquet(path)
    schema = static.schema
    if cells is None:
        # enough cells that a (window, cell) group stays far below the whole
        # table even if one window held everything
        cells = max(shuffle_partitions(spark), -(-static.count() // ROWS_PER_STREAM_CELL))
    bounds = merge_narrow_bounds(quantile_bounds(static, value_col, cells), float(radius))
    src = path if not path.endswith(".parquet") else path[:-1] + "[t]"  # a glob: the source wants a folder
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    marker_dir = scratch_path(spark, "stream-end-marker")
    spark.createDataFrame([], schema).write.parquet(marker_dir)
    stream = reader.parquet(src).unionByName(spark.readStream.schema(schema).parquet(marker_dir))
    result = stream_outlier_counts(stream, size, slide, radius, k, bounds, ts_col=ts_col,
                                   value_col=value_col, delay=delay)
    out = scratch_path(spark, "stream-result")
    q = (result.writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "stream-state")).start())
    try:
        q.processAllAvailable()
        if flush:
            row = {f.name: None for f in schema.fields}
            row[ts_col] = _FAR_FUTURE
            row[value_col] = 0.0
            spark.createDataFrame([row], schema).write.mode("append").parquet(marker_dir)
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(result.schema).parquet(out)
