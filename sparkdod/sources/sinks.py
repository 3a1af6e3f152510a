"""Result sinks (K1).

The reference prints ``"<window end>;<outliers>"`` lines. Batch results are
written with the DataFrame writer, streams with ``writeStream``; the text
form is one ``concat_ws``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.outliers import window_outlier_lines

__all__ = ["window_outlier_lines", "write_result", "write_lines"]


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write any result table (parquet by default)."""
    df.write.mode(mode).format(fmt).save(path)


def write_lines(counts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write window outlier counts in the reference's text form."""
    window_outlier_lines(counts).write.mode(mode).text(path)
