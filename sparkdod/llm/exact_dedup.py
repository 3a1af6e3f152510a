"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Documents are compared by the SHA-256 of their text without ASCII white space.
A frequent-items sketch of the Misra-Gries family (``approx_top_k``: bounded
counters, mergeable, every digest above about 1/500 of the rows is certain to be
among its items) proposes frequent digests; one exact aggregation verifies
their counts and winners. Those at most ``frequent`` winners are broadcast, so
rows of hot digests are decided where they are read. All other digests are
aggregated, map-side first, in one ordinary shuffle of (id, length, digest), and rows
join the groups of two or more; a digest that is just not hot is split by that join.

Of equal texts the row with the most code points stays, then the smallest
``doc_id`` (NULL last), then the first of repeated rows: exactly one row of a
group is kept. NULL text counts as empty. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, id_text, SPACE, whole_row


def without_space(text: Column) -> Column:
    """The text without ASCII white space."""
    for c in SPACE:
        text = F.replace(text, F.lit(c))
    return text


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, order, row`` with ``order`` sorting a group's winner first."""
    rows = id_text(docs).select("doc_id", F.length("text").alias("n_cp"), F.sha2(without_space(F.col("text")).cast("binary"), 256).alias("digest"),
                                F.monotonically_increasing_id().alias("row"))
    return checkpointed(rows).select("digest", F.struct((-F.col("n_cp")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("order"))


def exact_dedup(docs: DataFrame, frequent: int = 1024, tracked: int = 8192) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest``: one row per input row."""
    rows = digests(docs)
    items = rows.agg(F.expr(f"approx_top_k(digest, {frequent}, {tracked})").alias("top")).select(F.explode("top.item").alias("digest"))
    winners = rows.join(F.broadcast(items), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min("order").alias("winner"))
    winners = checkpointed(winners)  # at most `frequent` rows
    hot = rows.join(F.broadcast(winners), "digest")
    others = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = others.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min("order").alias("winner")).filter("group_size > 1")
    rest = others.join(groups, "digest", "left").select(
        "digest", "order", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("winner", "order").alias("winner"))
    return hot.unionByName(rest).select(
        F.col("order.doc_id").alias("doc_id"), F.col("winner.doc_id").alias("keep_id"), "group_size",
        (F.col("order.row") == F.col("winner.row")).alias("kept"), "digest")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that ``exact_dedup`` keeps; of
    rows with the same id and equal text one."""
    keep = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("i"), F.col("digest").alias("d"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(whole_row(docs).alias("own"), F.col("doc_id").cast("long").alias("doc_id"),
                      F.sha2(without_space(text).cast("binary"), 256).alias("digest"), F.length(text).alias("n_cp"))
    kept = own.join(keep, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
    first = Window.partitionBy("digest").orderBy(F.desc("n_cp"))  # one id each: few rows
    return kept.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("own.*")
