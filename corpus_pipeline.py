"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept; all but the last return the columns of ``documents``. ``run`` writes each
stage as Parquet into the cluster's shared folder and reads it again; the table
before it is removed then, so that one copy (the mix) is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdod.llm import bpe, exact_dedup, mixing, near_dup, toxicity
from sparkdod.llm.common import documents
from sparkdod.llm.queries import severity_grade
from sparkdod.session import ensure_checkpoint_dir, remove_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go. It is fitted on the labels of ``documents``."""
    model = toxicity.train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), severity_grade())
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    return near_dup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every text of the mix."""
    return bpe.encode(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", tokens)]

#: Fitting, balanced sampling and tokenizing are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
