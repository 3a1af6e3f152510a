"""Point sources.

The reference reads text lines ``id&value``. Here any reader works: text
files, parquet tables, or a streaming source; malformed rows go to a rejects
DataFrame instead of failing the job (D5).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: the field separator of the reference's text format
FIELD_SEPARATOR = "&"


def _parsed(lines: DataFrame, line_col: str, sep: str) -> DataFrame:
    parts = F.split(F.col(line_col), rf"\Q{sep}\E")
    id_txt = F.try_element_at(parts, F.lit(1))
    value_txt = F.try_element_at(parts, F.lit(2))
    value = value_txt.try_cast("double")
    ok = (F.size(parts) >= 2) & id_txt.try_cast("long").isNotNull() & value.isNotNull() & \
        ~F.isnan(value) & (F.abs(value) != float("inf"))
    return lines.select(F.col(line_col).alias("line"), id_txt.try_cast("long").alias("id"),
                        value.alias("value"), F.coalesce(ok, F.lit(False)).alias("__ok"))


def parse_points(lines: DataFrame, line_col: str = "value", sep: str = FIELD_SEPARATOR
                 ) -> tuple[DataFrame, DataFrame]:
    """Split ``id&value`` lines into ``(points, rejects)``.

    ``points``: (id LONG, value DOUBLE). ``rejects``: (line STRING) for empty
    lines, a missing field, a non-numeric id or value, NaN or infinity. Extra
    fields after the value are ignored, as in the reference."""
    p = _parsed(lines, line_col, sep)
    points = p.where("__ok").select("id", "value")
    rejects = p.where(~F.col("__ok")).select("line")
    return points, rejects


def read_text_points(spark: SparkSession, path: str, sep: str = FIELD_SEPARATOR,
                     streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """S1 + S2: read ``id&value`` text (a file, folder or glob) once; with
    ``streaming=True`` new files of the folder are picked up as they land."""
    reader = spark.readStream if streaming else spark.read
    return parse_points(reader.text(path), "value", sep)


def points_from_table(df: DataFrame, id_col: str, value: str | Sequence[str] | None = None, *,
                      vector_col: str | None = None, ts_col: str | None = None,
                      keep: Sequence[str] = ()) -> DataFrame:
    """S3: standard point columns from any table.

    One value column -> ``(id, value)``; several number columns or an array
    column -> ``(id, vec ARRAY<DOUBLE>)``. ``ts`` is carried when given. Rows
    with NULL / NaN coordinates are dropped (see ``parse_points`` for a
    rejects output)."""
    cols: list[Column] = [F.col(id_col).cast("long").alias("id")]
    if vector_col is not None:
        vec = F.col(vector_col).cast("array<double>")
        cols.append(vec.alias("vec"))
        valid = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    elif isinstance(value, str):
        v = F.col(value).cast("double")
        cols.append(v.alias("value"))
        valid = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    elif value:
        vec = F.array(*[F.col(c).cast("double") for c in value])
        cols.append(vec.alias("vec"))
        valid = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    else:
        raise ValueError("give a value column, several number columns or vector_col")
    if ts_col is not None:
        cols.append(F.col(ts_col).alias("ts"))
    cols.extend(F.col(c) for c in keep)
    return df.where(valid & F.col(id_col).isNotNull()).select(*cols)


def lines_from_table(df: DataFrame, id_col: str, value_col: str, sep: str = FIELD_SEPARATOR) -> DataFrame:
    """The reference's text format built from a table: ``(value STRING)``
    lines ``id&value`` (the inverse of ``parse_points``)."""
    return df.select(F.concat_ws(sep, F.col(id_col).cast("string"), F.col(value_col).cast("string")).alias("value"))
