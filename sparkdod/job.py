"""The outlier job from the command line (the reference's ``main``).

Reads points (``id&value`` text lines, or a table with an id and a value
column), counts distance outliers per sliding window and prints or writes
``window_end;outliers`` lines; ``--stream`` runs it continuously over a
folder of files.

    python -m sparkdod.job --input data/ --count-window 100000 --count-slide 50000 \\
        --radius 0.45 --k 50 [--output out/] [--stream --checkpoint ck/]
"""

from __future__ import annotations

import argparse
import math

from pyspark.sql import functions as F

from .operators.outliers import window_outlier_counts, window_outlier_lines
from .operators.windows import Windows, count_based_time
from .session import get_spark, scratch_path, shuffle_partitions
from .sources.points import points_from_table, read_text_points
from .streaming.outliers import DEFAULT_DELAY, stream_outlier_counts

# fixed values: the reference's default workload
DEFAULTS = {"count_window": 100_000, "count_slide": 50_000, "radius": 0.45, "k": 50}


def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sparkdod.job", description=__doc__.split("\n\n")[0])
    p.add_argument("--input", required=True, help="text folder/file of id&value lines, or a parquet table")
    p.add_argument("--format", choices=["text", "parquet"], default="text")
    p.add_argument("--id-col", default="id")
    p.add_argument("--value-col", default="value")
    p.add_argument("--ts-col", help="event-time column (time windows)")
    p.add_argument("--count-window", type=int, default=DEFAULTS["count_window"])
    p.add_argument("--count-slide", type=int, default=DEFAULTS["count_slide"])
    p.add_argument("--time-window", help="e.g. '10 seconds' (with --ts-col)")
    p.add_argument("--time-slide", help="e.g. '5 seconds'")
    p.add_argument("--radius", type=float, default=DEFAULTS["radius"])
    p.add_argument("--k", type=int, default=DEFAULTS["k"])
    p.add_argument("--output", help="folder for the text result (default: print)")
    p.add_argument("--rejects", help="folder for the input lines that are no points (text input)")
    p.add_argument("--stream", action="store_true", help="process files as they arrive")
    p.add_argument("--checkpoint", help="streaming checkpoint folder (default: under spark.checkpoint.dir)")
    p.add_argument("--delay", default=DEFAULT_DELAY, help="watermark delay incl. allowed lateness")
    p.add_argument("--master")
    return p.parse_args(argv)


def stream_lines(spark, a: argparse.Namespace, points):
    """The streaming plan of the job: ``value`` lines ``window_end;outliers``.
    Count windows run on a synthetic time (P1, W10), one second for the largest
    step that divides both window and slide; labels are those of the batch form."""
    from .operators.cells import merge_narrow_bounds, quantile_bounds
    from .streaming.outliers import ROWS_PER_STREAM_CELL
    count_windows = not (a.ts_col and a.time_window)
    if not count_windows:
        size, slide, ts = a.time_window, a.time_slide or a.time_window, "ts"
    else:
        step = math.gcd(a.count_window, a.count_slide)
        points = count_based_time(points, step, "1 second")
        size, slide, ts = f"{a.count_window // step} seconds", f"{a.count_slide // step} seconds", "ts"
    static = spark.read.parquet(a.input) if a.format == "parquet" else read_text_points(spark, a.input)[0]
    cells = max(shuffle_partitions(spark), -(-static.count() // ROWS_PER_STREAM_CELL))
    bounds = merge_narrow_bounds(quantile_bounds(static, "value" if a.format == "text" else a.value_col, cells),
                                 a.radius)
    counts = stream_outlier_counts(points, size, slide, a.radius, a.k, bounds, ts_col=ts, delay=a.delay)
    if count_windows:  # seconds since the epoch times the step = id at the window's end
        end = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("window_end")) * step
        if a.count_window % a.count_slide == 0:
            end = F.floor(end / a.count_slide)
        counts = counts.withColumn("window_end", end)
    return window_outlier_lines(counts).withColumnRenamed("line", "value")


def main(argv=None) -> None:
    a = parse_args(argv)
    spark = get_spark(a.master)
    if a.format == "text":
        points, rejects = read_text_points(spark, a.input, streaming=a.stream)
    else:
        reader = spark.readStream.schema(spark.read.parquet(a.input).schema) if a.stream else spark.read
        points = points_from_table(reader.parquet(a.input), a.id_col, a.value_col, ts_col=a.ts_col)
    if a.stream:
        if a.rejects and a.format == "text":
            rejects.writeStream.format("text").option("path", a.rejects).option(
                "checkpointLocation", scratch_path(spark, "job-rejects")).start()
        lines = stream_lines(spark, a, points)
        w = lines.writeStream.outputMode("append").option(
            "checkpointLocation", a.checkpoint or scratch_path(spark, "job-stream"))
        q = (w.format("text").option("path", a.output) if a.output else w.format("console")).start()
        q.awaitTermination()
        return
    if a.ts_col and a.time_window:
        windows = Windows.time(a.time_window, a.time_slide or a.time_window, "ts")
    else:
        windows = Windows.count(a.count_window, a.count_slide)
    if a.rejects and a.format == "text":
        rejects.write.mode("overwrite").text(a.rejects)
    lines = window_outlier_lines(window_outlier_counts(points, windows, a.radius, a.k).orderBy("window_end"))
    if a.output:
        lines.write.mode("overwrite").text(a.output)
    else:
        for row in lines.toLocalIterator():
            print(row.line)


if __name__ == "__main__":
    main()
