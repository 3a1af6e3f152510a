"""Value-range cells (R1-R3) and fixed-width grids.

Cells split one window's points over many tasks. Equi-depth bounds come
from ``approxQuantile`` (a Greenwald-Khanna sketch merged on the driver: the
driver only ever receives ``n_cells - 1`` numbers). Cell lookup is a binary
search inside the JVM (``Bucketizer``), not a per-row scan of the bounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.partitioning import materialize
from .ranking import numbered
from .windows import floor_div

# Relative slack that absorbs floating-point rounding of ``value +- R``:
# the rounding error of those sums is below 2**-52 * (|value| + R).
ROUNDING_SLACK = 2.0 ** -50


def quantile_bounds(df: DataFrame, col: str, n_cells: int, rel_error: float | None = None,
                    sample_fraction: float | None = None, seed: int = 17) -> list[float]:
    """Ascending, distinct equi-depth bounds (``n_cells - 1`` at most).

    Hot values collapse into one bound, so a cell never splits one value;
    the outlier operators count duplicates once per distinct value, which
    keeps a hot value from overloading its cell."""
    if n_cells <= 1:
        return []
    src = df.select(F.col(col).cast("double").alias("k")).where(
        F.col("k").isNotNull() & ~F.isnan("k") & (F.abs("k") != float("inf")))
    if sample_fraction is not None and sample_fraction < 1.0:
        src = src.sample(fraction=sample_fraction, seed=seed)
    probs = [i / n_cells for i in range(1, n_cells)]
    err = rel_error if rel_error is not None else 1.0 / (4.0 * n_cells)
    qs = src.approxQuantile("k", probs, err)
    return sorted({q for q in qs if q is not None and math.isfinite(q)})


def exact_bounds(df: DataFrame, col: str, n_cells: int) -> list[float]:
    """R3 without an error: the distinct values at ranks ``ceil(i * n / n_cells)``, ``0 < i < n_cells``, so a cell holds at
    most ``ceil(n / n_cells)`` rows besides copies of its bound.

    Copies are counted first, map-side, and distinct values numbered by range partitions with the
    counts as weights; only the bounds reach the driver. NULL, NaN and infinite values are left out."""
    key = F.col(col).cast("double")
    values = df.select(key.alias("k")).where(key.isNotNull() & ~F.isnan(key) & (F.abs(key) != float("inf"))) \
        .groupBy((F.col("k") + F.lit(0.0)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    run = materialize(numbered(values, "k", out_col="run", weight=F.col("n")))
    total = run.agg(F.max("run")).first()[0]
    if total is None or n_cells <= 1:
        return []
    reached = [floor_div(x * F.lit(n_cells), total) for x in (F.col("run"), F.col("run") - F.col("n"))]
    return sorted(r["k"] for r in run.where(F.least(reached[0], F.lit(n_cells - 1)) > reached[1]).select("k").collect())


def merge_narrow_bounds(bounds: Sequence[float], min_width: float) -> list[float]:
    """Drop bounds closer than ``min_width`` to the previous kept one, so no
    inner cell is narrower than ``min_width``: with ``min_width = R`` a point's
    radius touches at most three cells and replication stays below 3x."""
    out: list[float] = []
    for b in sorted(set(bounds)):
        if not out or b - out[-1] >= min_width:
            out.append(b)
    return out


def with_cell(df: DataFrame, key: Column | str, bounds: Sequence[float], out_col: str = "cell") -> DataFrame:
    """``cell = #{b in bounds : b < key}``.

    Upper bounds are inclusive: a key equal to ``b_i`` lands in cell ``i``; a
    key above every bound lands in the last cell ``len(bounds)``. Monotone in
    the key, so cell order equals key order."""
    key = F.col(key) if isinstance(key, str) else key
    bounds = sorted(set(float(b) for b in bounds))
    if not bounds:
        return df.withColumn(out_col, F.lit(0).cast("long"))
    # Bucketizer puts x in j when splits[j] <= x < splits[j+1]; on the negated
    # key that is b_(n-1-j) < key <= b_(n-j), i.e. #{b < key} = n - j.
    splits = [-math.inf] + [-b for b in reversed(bounds)] + [math.inf]
    tmp_in, tmp_out = f"__neg_{out_col}", f"__bkt_{out_col}"
    bucketed = Bucketizer(splits=splits, inputCol=tmp_in, outputCol=tmp_out,
                          handleInvalid="keep").transform(df.withColumn(tmp_in, -key.cast("double")))
    return bucketed.withColumn(out_col, (F.lit(len(bounds)) - F.col(tmp_out)).cast("long")) \
        .drop(tmp_in, tmp_out)


def replicate(df: DataFrame, value_col: str, bounds: Sequence[float], radius: float,
              cell_col: str = "cell", replica_col: str = "is_replica") -> DataFrame:
    """R2: the owner row plus one copy in every other cell that holds a value
    within ``radius`` (not only the adjacent cell, which misses pairs when a
    cell is narrower than the radius, D1)."""
    v = F.col(value_col)
    r = float(radius)
    slack = (F.abs(v) + F.lit(r)) * F.lit(ROUNDING_SLACK)
    out = with_cell(df, v, bounds, "__own")
    out = with_cell(out, v - F.lit(r) - slack, bounds, "__lo")
    out = with_cell(out, v + F.lit(r) + slack, bounds, "__hi")
    out = out.withColumn(cell_col, F.explode(F.sequence("__lo", "__hi")))
    return out.withColumn(replica_col, F.col(cell_col) != F.col("__own")).drop("__own", "__lo", "__hi")


#: Cell numbers beyond this are one cell (LONG holds them, with room for the cells next to it).
MOST_CELLS = 2.0 ** 62


def grid_width(radius: float) -> float:
    """The smallest power of two not below the radius: dividing by it is exact."""
    m, e = math.frexp(radius)
    return (math.ldexp(1.0, e - 1) if m == 0.5 else math.ldexp(1.0, e)) if radius > 0 else 1.0


def grid_cell(value: Column, width: float) -> Column:
    """Fixed-width grid cell ``floor(value / width)``."""
    at = value / F.lit(float(width))
    return F.floor(F.greatest(F.least(at, F.lit(MOST_CELLS)), F.lit(-MOST_CELLS))).cast("long")


def grid_reach(value: Column, radius: float, width: float) -> Column:
    """ARRAY of the grid cells that can hold a value within ``radius`` of
    ``value`` under the exact predicate ``abs(a - b) <= radius`` in DOUBLE: at most five.

    ``floor(x / w)`` is monotone in x, so padding the interval by the rounding
    slack is enough for any magnitude. Where the slack is wider than cells, the
    width (a power of two, ``grid_width``) bounds the list: cell numbers are exact and
    two values within ``radius <= width`` lie at most two cells apart."""
    r = float(radius)
    slack = (F.abs(value) + F.lit(r)) * F.lit(ROUNDING_SLACK)
    own = grid_cell(value, width)
    lo, hi = grid_cell(value - F.lit(r) - slack, width), grid_cell(value + F.lit(r) + slack, width)
    return F.sequence(F.greatest(lo, own - 2), F.least(hi, own + 2))
