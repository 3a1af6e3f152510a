"""Helpers shared by the operators: table access, words, Arrow slices, shared storage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = "\t\n\x0b\x0c\r "


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as LONG and ``text`` with NULL as the empty text; any other
    column (also one whose name an operator uses itself) is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names hold (dots, backticks)."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def checkpointed(df: DataFrame) -> DataFrame:
    """Write once to the cluster's shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of about ``max_bytes`` (one row at least),
    without copying. A worker waits for its next task without the memory of this one."""
    for batch in batches:
        rows = batch.num_rows
        if rows:
            step = max(1, rows * max_bytes // max(1, batch.nbytes))
            for at in range(0, rows, step):
                yield batch.slice(at, step)
        pa.default_memory_pool().release_unused()


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """Blocks of about ``block_bytes`` of text, at least four for each shuffle partition or core."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = 4 * min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    return int(max(1, least, -(-total // block_bytes)))
