"""Extremes (A8) and fixed-size samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extremes(points: DataFrame, id_col: str = "id", value_col: str = "value") -> DataFrame:
    """The points with the least and the greatest value (ties -> lower
    id): one row (min_id, min_value, max_id, max_value); NULLs when empty.
    A plain global aggregate: partial min/max per task, one tiny merge."""
    v, i = F.col(value_col), F.col(id_col)
    return points.agg(
        F.min_by(i, F.struct(v, i)).alias("min_id"), F.min(v).alias("min_value"),
        F.max_by(i, F.struct(v, -i)).alias("max_id"), F.max(v).alias("max_value"))


def sample_n(df: DataFrame, n: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``n`` rows drawn uniformly without replacement (all rows when the
    table is smaller). The draw ranks rows by ``md5(id:seed)``, so it is
    repeatable anywhere and independent of partitioning; Spark plans
    ``orderBy + limit`` as a per-task top-n, never a full sort."""
    if n <= 0:
        return df.limit(0)
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(int(seed)))))
    return df.withColumn("__draw", key).orderBy("__draw", id_col).limit(int(n)).drop("__draw")
