"""Micro-batches over tables of panes: windows that fire again (W5), points and the clusters before them.

A micro-batch writes its points below ``batch=<number>/pane=<number>`` in the shared
checkpoint folder and reads back only the panes that a due window asks for, however long the
stream is. A batch that is repeated after a failure replaces its own folders and finds
what it found before, so results are those of a batch that ran once. Panes that no later
batch can ask for are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clusters import assign_in_windows, cell_center, cell_number
from ..operators.neighbors import check_radius
from ..operators.outliers import window_outlier_counts
from ..operators.search import finite
from ..operators.windows import Windows, to_micros
from ..session import scratch_path
from .window_outliers import DEFAULT_DELAY, run_to_end

# fixed values: the reference's out-of-orderness and allowed lateness
OUT_OF_ORDER, LATENESS = "1 second", "1 second"
#: before every window
NEVER = -(1 << 62)
POINT = "id long, value double, t long"
CLUSTER = "cell long, center double, points long"


class PaneTable:
    """Rows by (batch, pane) in a folder that all executors share."""

    def __init__(self, spark: SparkSession, name: str, columns: str):
        self.spark, self.folder, self.columns = spark, scratch_path(spark, name), columns

    def write(self, rows: DataFrame, batch: int) -> None:
        names = [f.name for f in T.StructType.fromDDL(self.columns)]
        rows.select(*names, "pane").write.mode("overwrite").partitionBy("pane").parquet(f"{self.folder}/batch={batch}")

    def read(self) -> DataFrame:
        """All rows, with ``batch`` and ``pane``: filters on these two prune folders."""
        return self.spark.read.schema(f"{self.columns}, batch long, pane long").parquet(self.folder)

    def forget(self, before: int) -> None:
        """Remove the panes below ``before``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch=*/pane=*")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(path) or ():
            number = status.getPath().getName().removeprefix("pane=")
            if number.lstrip("-").isdigit() and int(number) < before:
                fs.delete(status.getPath(), True)


class Progress:
    """What a batch leaves to the next one: the latest event time seen (microseconds) and the last window it closed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch_path(spark, "stream-progress")

    def before(self, batch: int) -> tuple[int | None, int]:
        if not batch:
            return None, NEVER
        row = self.spark.read.schema("moment long, closed long").parquet(f"{self.folder}/{batch - 1}").first()
        return row["moment"], row["closed"]

    def write(self, batch: int, moment: int | None, closed: int) -> None:
        self.spark.createDataFrame([(moment, closed)], "moment long, closed long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{batch}")


def _sliding(size, slide, ts_col: str) -> Windows:
    w = Windows.time(size, slide, ts_col)
    if w.panes_per_window is None or w.slide % 1000:
        raise ValueError("the slide must divide the window size and be whole milliseconds")
    return w


def _points(stream: DataFrame, w: Windows, id_col: str, value_col: str) -> DataFrame:
    rows = stream.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).cast("double").alias("value"), w.position(stream).alias("t"))
    return rows.where("t is not null")


def _latest(*moments: int | None) -> int | None:
    return max((m for m in moments if m is not None), default=None)


# -- windows that fire again ------------------------------------------------------
def due_windows(before: int | None, now: int | None, m: int, slide: int, out_of_order: int, lateness: int) -> tuple[int, int, int]:
    """``(first, closed, last)`` of a micro-batch: windows ``closed + 1 .. last`` fire for the first time, those
    from ``first`` to ``closed`` fire again if a row reaches them; earlier ones are over.

    ``before`` and ``now`` are the latest event times before and after it (microseconds)."""
    if now is None:
        return NEVER, NEVER, NEVER
    last = (now - out_of_order) // slide
    if before is None:
        return NEVER, NEVER, last
    mark = before - out_of_order
    return (mark - lateness) // slide + 1, mark // slide, last


def run_stream_refired_counts(spark: SparkSession, path: str, size, slide, radius: float, k: int, *, id_col: str = "id", ts_col: str = "ts",
                              value_col: str = "value", out_of_order: str = OUT_OF_ORDER, lateness: str = LATENESS, flush: bool = True,
                              files_per_batch: int | None = None, versions: bool = False) -> DataFrame:
    """O1 over a file stream with late firings (W5): ``(window_end, outliers, version)``.

    A window fires once the latest event time passes its end by ``out_of_order``. Until it passes that by
    ``lateness`` more, a micro-batch with rows of the window fires it again, with the batch number as its version;
    the version with the highest number holds (``versions``: all of them). A row that comes later still does
    not count in that window, but in those of its windows that are not over.

    Rows are stored once, by pane; a firing counts the panes of its windows by the batch operator, in which
    no cell or value is a hot group. What reaches the driver are the late panes of a batch: at most
    a window's and ``lateness`` worth. NULL, NaN and infinite values are no points (D5)."""
    radius, w = check_radius(radius), _sliding(size, slide, ts_col)
    m, step, wait, late = w.panes_per_window, w.slide, to_micros(out_of_order), to_micros(lateness)
    table, progress, plain = PaneTable(spark, "stream-panes", POINT), Progress(spark), Windows.time(size, slide, "ts")

    def fire(batch: DataFrame, number: int) -> DataFrame:
        before, _ = progress.before(number)
        now = _latest(before, batch.agg(F.max("t")).first()[0])
        first, closed, last = due_windows(before, now, m, step, wait, late)
        rows = batch.where(finite("value", False)).withColumn("pane", w.pane(F.col("t"))).where(F.col("pane") + m >= first)
        table.write(rows, number)
        late_panes = [r[0] for r in rows.where(F.col("pane") < closed).select("pane").distinct().collect()]
        again = sorted({e for p in late_panes for e in range(max(p + 1, first), min(p + m, closed) + 1)})
        progress.write(number, now, last)
        table.forget(first - m)
        lowest = min([closed + 1, *again])
        panes = table.read().where((F.col("pane") >= lowest - m) & (F.col("pane") < last)).select("id", "value", F.timestamp_micros("t").alias("ts"))
        counts = window_outlier_counts(panes, plain, radius, k).select((F.unix_micros("window_end") / step).cast("long").alias("window"), "outliers")
        due = F.col("window").between(closed + 1, last) | F.col("window").isin(again)
        return counts.where(due).withColumn("version", F.lit(number).cast("long"))

    out = run_to_end(spark, path, lambda s: _points(s, w, id_col, value_col), lambda r: "window long, outliers long, version long",
                     ts_col=ts_col, flush=flush, files_per_batch=files_per_batch, step=fire)
    if not versions:
        out = out.groupBy("window").agg(F.max(F.struct("version", "outliers")).alias("r")).select("window", "r.*")
    return out.select(w.label(F.col("window"), spark.read.parquet(path)).alias("window_end"), "outliers", "version")


# -- clusters on a stream ---------------------------------------------------------
def stream_dense_clusters(points: DataFrame, size, slide, radius: float, k: int, *, ts_col: str = "ts", value_col: str = "value",
                          delay: str = DEFAULT_DELAY) -> DataFrame:
    """O4 on a streaming DataFrame: ``(window, cell, center, points)`` of every dense cell, ``window`` being the number
    ``end / slide``, once the watermark passes the window.

    Chained event-time aggregations: points are counted per (pane, cell), each once and map-side
    first, and a pane's counts enter its ``m`` windows as one row a cell."""
    radius, w = check_radius(radius), _sliding(size, slide, ts_col)
    value, usable = F.col("value"), finite("value", False)
    rows = points.select(F.col(value_col).cast("double").alias("value"), F.timestamp_micros(w.position(points)).alias("moment")).withWatermark("moment", delay)
    # rows that are no points count nothing, but their time passes
    panes = rows.groupBy(F.window("moment", f"{w.slide} microseconds").alias("pane"), F.when(usable, cell_number(value, radius)).alias("cell")) \
        .agg(F.count_if(usable).alias("points"), F.max(F.when(usable, F.abs(value))).alias("far"))
    entering = panes.select(F.window_time("pane").alias("moment"), "cell", "points", "far")
    cells = entering.groupBy(F.window("moment", f"{w.size} microseconds", f"{w.slide} microseconds").alias("w"), "cell") \
        .agg(F.sum("points").alias("points"), F.max("far").alias("far")).where(F.col("points") > k)
    return cells.select((F.unix_micros("w.end") / w.slide).cast("long").alias("window"), "cell", cell_center(F.col("cell"), F.col("far"), radius).alias("center"), "points")


def run_stream_assign_clusters(spark: SparkSession, path: str, size, slide, radius: float, k: int, *, id_col: str = "id", ts_col: str = "ts",
                               value_col: str = "value", delay: str = DEFAULT_DELAY, flush: bool = True, files_per_batch: int | None = None) -> DataFrame:
    """O5 over a file stream: ``(id, window_end, cluster, distance)``, each point with the closest centre within ``R/2`` among the
    clusters of the last window over when its slide begins (``window_end`` is that moment); -1 if none is near.

    One query: points pass through beside the clusters of ``stream_dense_clusters``, which are refreshed each
    slide. A point waits in its pane's folder until the watermark passes ``window_end``, then it meets the clusters of that
    window alone, by an equi-join on (window, grid cell) in which Spark splits a hot cell.
    A point that comes when its whole slide is behind the watermark of the batch before is dropped."""
    radius, w = check_radius(radius), _sliding(size, slide, ts_col)
    wait = to_micros(delay)
    waiting, clusters, progress = PaneTable(spark, "stream-waiting", POINT), PaneTable(spark, "stream-clusters", CLUSTER), Progress(spark)

    def build(stream: DataFrame) -> DataFrame:
        points = _points(stream, w, id_col, value_col).withColumn("pane", w.pane(F.col("t")))
        found = stream_dense_clusters(stream, size, slide, radius, k, ts_col=ts_col, value_col=value_col, delay=delay)
        return points.unionByName(found.withColumnRenamed("window", "pane"), allowMissingColumns=True)

    def assign(batch: DataFrame, number: int) -> DataFrame:
        before, last = progress.before(number)
        now = _latest(before, batch.agg(F.max("t")).first()[0])
        closed = NEVER if before is None else max(last, (before - wait) // w.slide)
        own = batch.where(F.col("t").isNotNull() & finite("value", False) & (F.col("pane") >= last))
        waiting.write(own, number)
        clusters.write(batch.where("t is null"), number)
        progress.write(number, now, closed)
        waiting.forget(last)
        clusters.forget(last)
        pane = F.col("pane")
        due = (pane > last) & (pane <= closed) | (pane == last) & (F.col("batch") == number)
        ready = waiting.read().where(due).select("id", "value", pane.alias("window"))
        centers = clusters.read().where(pane.between(last, closed)).select(pane.alias("window"), "cell", "center")
        return assign_in_windows(ready, centers, radius)

    out = run_to_end(spark, path, build, lambda r: "id long, window long, cluster long, distance double", ts_col=ts_col, flush=flush,
                     files_per_batch=files_per_batch, step=assign)
    return out.select("id", w.label(F.col("window"), spark.read.parquet(path)).alias("window_end"), "cluster", "distance")
