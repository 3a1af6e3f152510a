"""Sliding windows over a point table.

A window spec turns every point into a *position* (its id for count windows,
microseconds since the epoch for time windows) and every window into a LONG
*end number*. Windows start on multiples of the slide, as Spark's
``window()`` does, and cover ``[start, start + size)``.

When the slide divides the size, each window is the union of ``m = size /
slide`` consecutive *panes* (slides). The outlier operators then count
neighbours per pane once and add the panes of each window, instead of
repeating the work for every overlapping window.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

# fixed values: interval unit names and their length in microseconds
_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}
_INTERVAL = re.compile(r"^\s*(\d+)\s*([a-z]+?)s?\s*$")


def floor_div(a: Column, b: int) -> Column:
    """Exact LONG floor division: no detour through DOUBLE, negatives round
    down (D7)."""
    bl = F.lit(int(b)).cast("long")
    return F.call_function("div", a - F.pmod(a, bl), bl)


def to_micros(duration: str | int | timedelta) -> int:
    """'2 days', '500 milliseconds', a timedelta or an int of microseconds."""
    if isinstance(duration, timedelta):
        return duration // timedelta(microseconds=1)
    if isinstance(duration, int):
        return duration
    m = _INTERVAL.match(duration.lower())
    if not m or m.group(2) not in _UNIT_MICROS:
        raise ValueError(f"cannot read duration {duration!r}")
    return int(m.group(1)) * _UNIT_MICROS[m.group(2)]


@dataclass(frozen=True)
class Windows:
    """Sliding (or tumbling, ``slide == size``) windows.

    ``by='count'``: positions are ids, ``size``/``slide`` are numbers of ids;
    the window number is ``end / slide`` (window ``e`` covers ids
    ``[e*slide - size, e*slide)``).
    ``by='time'``: positions are event-time microseconds; the window label is
    the end timestamp of the same kind (NTZ or LTZ) as the input column.
    """

    by: str
    size: int
    slide: int
    column: str

    @staticmethod
    def count(size: int, slide: int | None = None, id_col: str = "id") -> "Windows":
        return Windows("count", int(size), int(slide or size), id_col)

    @staticmethod
    def time(size, slide=None, ts_col: str = "ts") -> "Windows":
        s = to_micros(size)
        return Windows("time", s, to_micros(slide) if slide is not None else s, ts_col)

    def __post_init__(self):
        if self.size <= 0 or self.slide <= 0:
            raise ValueError("window size and slide must be positive")
        if self.by not in ("count", "time"):
            raise ValueError("by must be 'count' or 'time'")

    # -- positions ---------------------------------------------------------
    @property
    def panes_per_window(self) -> int | None:
        """m when the slide divides the size, else None."""
        return self.size // self.slide if self.size % self.slide == 0 else None

    def position(self, df: DataFrame) -> Column:
        """LONG position of every row: id, or event-time microseconds."""
        c = F.col(self.column)
        if self.by == "count":
            return c.cast("long")
        dtype = df.schema[self.column].dataType
        if isinstance(dtype, T.TimestampNTZType):
            return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), c)
        if isinstance(dtype, T.TimestampType):
            return F.unix_micros(c)
        if isinstance(dtype, T.DateType):
            return F.unix_micros(c.cast("timestamp"))
        return c.cast("long")  # already microseconds

    def pane(self, position: Column) -> Column:
        """Slide number ``floor(position / slide)`` (negative ids included, D7)."""
        return floor_div(position, self.slide)

    def window_numbers(self, position: Column) -> Column:
        """ARRAY<LONG> of the end numbers of all windows holding the position.

        Window ``k`` starts at ``k*slide`` and ends at ``k*slide + size``; its
        number is ``end`` in slide units when the slide divides the size,
        otherwise the start index ``k`` (labels convert both back)."""
        lo = floor_div(position - F.lit(self.size), self.slide) + 1
        hi = floor_div(position, self.slide)
        m = self.panes_per_window
        if m is not None:
            return F.sequence(lo + m, hi + m)
        # size < slide leaves gaps: a position may be in no window at all
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))

    def end_position(self, number: Column) -> Column:
        """Window end position (ids or micros) of a window number."""
        if self.panes_per_window is not None:
            return number * F.lit(self.slide)
        return number * F.lit(self.slide) + F.lit(self.size)

    def pane_label(self, pane: Column, df: DataFrame | None = None) -> Column:
        """Label of a pane (slide): its number for count windows, its start
        timestamp for time windows (the 'arrival' every point of the slide
        shares)."""
        if self.by == "count":
            return pane
        start_us = pane * F.lit(self.slide)
        dtype = df.schema[self.column].dataType if df is not None else T.TimestampNTZType()
        if isinstance(dtype, T.TimestampType):
            return F.timestamp_micros(start_us)
        return F.timestamp_add("MICROSECOND", start_us, F.expr(_EPOCH_NTZ))

    def label(self, number: Column, df: DataFrame | None = None) -> Column:
        """User-facing ``window_end``: slide number (count) or end timestamp."""
        if self.by == "count":
            if self.panes_per_window is not None:
                return number
            return self.end_position(number)
        end_us = self.end_position(number)
        dtype = df.schema[self.column].dataType if df is not None else T.TimestampNTZType()
        if isinstance(dtype, T.TimestampType):
            return F.timestamp_micros(end_us)
        return F.timestamp_add("MICROSECOND", end_us, F.expr(_EPOCH_NTZ))


def new_in_window(points_in_windows: DataFrame, windows: Windows, window_col: str = "window") -> DataFrame:
    """The points that entered with the window's last slide (the
    reference inserts only these per firing). Expects one row per (point,
    window number) with the point's position column."""
    pos = windows.position(points_in_windows)
    start_of_last = windows.end_position(F.col(window_col)) - F.lit(windows.slide)
    return points_in_windows.where(pos >= start_of_last)


def expiring(points_in_windows: DataFrame, windows: Windows, window_col: str = "window") -> DataFrame:
    """The points that leave after this window (its first slide)."""
    pos = windows.position(points_in_windows)
    start = windows.end_position(F.col(window_col)) - F.lit(windows.size)
    return points_in_windows.where(pos < start + F.lit(windows.slide))


def with_windows(points: DataFrame, windows: Windows, window_col: str = "window") -> DataFrame:
    """One row per (point, window number) (W3/W10 in batch form)."""
    return points.withColumn(window_col, F.explode(windows.window_numbers(windows.position(points))))


def count_based_time(points: DataFrame, slide: int, step, anchor=0, id_col: str = "id",
                     out_col: str = "ts") -> DataFrame:
    """Synthetic event time ``anchor + floor(id / slide) * step`` as
    TIMESTAMP_NTZ: all points of one slide share a timestamp. ``anchor``
    (microseconds or a duration since the epoch) defaults to the epoch; the
    reference takes the wall clock at start, which is not reproducible (D6)."""
    step_us = to_micros(step)
    anchor_us = anchor if isinstance(anchor, int) else to_micros(anchor)
    us = F.lit(anchor_us) + floor_div(F.col(id_col).cast("long"), slide) * F.lit(step_us)
    return points.withColumn(out_col, F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH_NTZ)))


def time_windows(points: DataFrame, size, slide=None, ts_col: str = "ts") -> DataFrame:
    """W3 in batch form: one row per (point, window) with ``window_end``.

    Same windows as ``pyspark.sql.functions.window(ts, size, slide)``."""
    w = Windows.time(size, slide, ts_col)
    pos = w.position(points)
    out = points.withColumn("__wn", F.explode(w.window_numbers(pos)))
    return out.withColumn("window_end", w.label(F.col("__wn"), points)).drop("__wn")
