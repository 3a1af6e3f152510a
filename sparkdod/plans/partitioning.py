"""Partitioning helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by the keys of the join that follows (it needs that
    exchange anyway) to at least as many partitions as there are cores. A join
    that emits many rows per input row runs with the parallelism of its
    streamed input, which a small input would otherwise leave at one task."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: an eager reliable
    ``checkpoint()`` into the session's shared checkpoint folder
    (``spark.checkpoint.dir``). Used for inputs that several branches of a
    plan read, so the source is scanned and shuffled once, and a lost
    executor never forces a replay of the whole lineage."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
