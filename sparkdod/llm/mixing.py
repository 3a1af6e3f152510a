"""Mixing sources to target weights by balanced (cube-method) sampling.

Sizes are words. A source's target is its share of all words by weight, capped
at ``most`` times its own size, with the excess shared again by weight. A
source is then taken ``target / size`` times: the whole part as full copies of
each document, the fraction as an inclusion probability for one more copy.

Which documents get that copy is decided by the cube method. In the flight
phase, three undecided documents at a time, a move in the null space of the
two constraints (documents, words) changes their probabilities until one of
them is 0 or 1, so the expected totals of both never change. Flights run in
blocks of one source; the few documents that a block leaves undecided (two, and
a spare handful of all sizes) are gathered, level by level, until a source fits
one block, and only its last documents are landed, closest to the words still
wanted. A hot source is just more blocks.

A document larger than its source's whole target can only be taken alone, as
every further one leads away from the target. So the others are drawn at the rate
that makes up for it, and if the smallest such document is nearer to the target
than their draw, it is taken in place of them. Random choices depend on the seed and on document ids alone: reruns agree.

NULL and empty texts have size 0 (and are taken 0 words). A NULL source is a
source, sorted last. Rows with the same ``doc_id`` are separate documents. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, whole_row, WORD

#: So many sources (a few tens of bytes each) may be broadcast.
MOST_BROADCAST = 100_000
FLIGHT = "source string, block long, row long, size long, p double, room int, take int"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Sources are numbered by range partitions (position inside the partition
    plus the rows of earlier ones); the level all uncapped sources share is
    found by a few aggregations. Only counts and sums reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = checkpointed(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per partition
    at = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int")).cast("double")
    table = checkpointed(parts.join(F.broadcast(before), "part").select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * F.lit(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # at least one more source is capped in each round
        is_capped = F.col("weight") * F.lit(level) > cap if capped >= 0 else F.lit(False)
        n, taken, weight_left = table.agg(F.count_if(is_capped), F.coalesce(F.sum(F.when(is_capped, cap)), F.lit(0.0)),
                                          F.coalesce(F.sum(F.when(~is_capped, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not weight_left:
            break
        capped, level = n, (total - taken) / weight_left
    return table.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _flight(rows: pd.DataFrame, rng: np.random.Generator, land: bool, spare: int = 64, tries: int = 64) -> pd.DataFrame:
    """Move the probabilities of ``rows`` (largest first) until at most two are
    undecided, besides ``spare`` documents of evenly spread sizes that stay out
    of the flight (when landing, more, until they hold several times the words
    of the largest document, so that they can make up for it). With ``land`` these last ones are the landing problem: each
    is taken, in random order, if that brings the words closer to those wanted;
    the best of some orders counts."""
    size, most, p = rows["size"].to_numpy(float), rows["room"].to_numpy(), rows["p"].to_numpy(float).copy()
    coins = rng.random(len(p))
    if not land:
        spare = min(spare, len(p) // 4)  # every level has fewer rows to fly
    while True:
        spared = np.unique(np.linspace(0, len(p) - 1, min(spare, len(p)) + 2)[1:-1].round().astype(int))
        if not land or spare >= len(p) or size[spared].sum() >= 8 * size[0]:
            break
        spare *= 2
    flying = np.ones(len(p), bool)
    flying[spared] = False
    live: list[int] = []
    for i in np.flatnonzero(flying):
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        # u is orthogonal to (1, 1, 1) and to the sizes
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for j, d in zip(live, u):
            if d > 0:
                up, down = min(up, (1 - p[j]) / d), min(down, p[j] / d)
            elif d < 0:
                up, down = min(up, p[j] / -d), min(down, (1 - p[j]) / -d)
        step = up if coins[i] * (up + down) < down else -down
        for j, d in zip(live, u):
            p[j] += step * d
            if not 1e-9 < p[j] < 1 - 1e-9:
                p[j] = round(p[j])
        live = [j for j in live if 0 < p[j] < 1]
    left = np.concatenate([live, spared]).astype(int)
    if land:
        wanted, best = float(p[left] @ size[left]), None
        for _ in range(tries):
            room, taken = wanted, np.zeros(len(left))
            # more copies only where one of each can't reach the words, as beside a document larger than all that is wanted
            for copy in range(int(most[left].max(initial=1))):
                before = room
                for k in rng.permutation(len(left)):
                    if copy < most[left[k]] and size[left[k]] < 2 * room:  # closer with it than without
                        room -= size[left[k]]
                        taken[k] += 1
                if room == before or copy == 0 and abs(room) < 1:
                    break
            if best is None or abs(room) < best[0]:
                best = (abs(room), taken)
        p[left] = best[1]
        left = left[:0]
    take = p.round().astype("int32")
    take[left] = -1
    return rows.assign(p=p, take=take)


def _flown(rows: DataFrame, seed: int, land: bool) -> DataFrame:
    def run(group):
        group = group.sort_values(["size", "row"], ascending=[False, True], ignore_index=True)
        rng = np.random.default_rng([seed, int(land), len(group), int(group["row"].iloc[0]) & (2 ** 63 - 1)])
        return _flight(group, rng, land)

    return rows.groupBy("source", "block").applyInPandas(run, FLIGHT)


def balanced_copies(rows: DataFrame, block_rows: int = 2048, seed: int = 1) -> DataFrame:
    """``row, take`` for ``source, row, size, p, room`` (most copies to add): the
    cube method. ``take`` is 0 or 1, in a landing up to ``room``."""
    done, level = [], 0
    while True:
        largest = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        counts = rows.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("blocks"))
        land = largest <= block_rows
        blocks = rows.join(counts, F.col("source").eqNullSafe(F.col("s"))).select(
            "source", F.pmod(F.xxhash64("row", F.lit(seed + level)), F.col("blocks")).alias("block"), "row", "size", "p", "room", F.lit(-1).alias("take"))
        flown = checkpointed(_flown(blocks, seed + level, land))
        done.append(flown.filter("take >= 0").select("row", "take"))
        if land:
            break
        rows, level = flown.filter("take < 0").select("source", "row", "size", "p", "room"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def with_row_key(rows: DataFrame) -> DataFrame:
    """``size`` (words) in place of ``text``, ``key`` (equal for equal id, source
    and size) and ``nth``, which numbers the rows of a key: repeated rows stay apart."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    keyed = rows.withColumn("size", size).drop("text").withColumn("key", F.xxhash64("doc_id", "source", "size"))
    return keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("doc_id")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, block_rows: int = 2048, seed: int = 1) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken, key, nth`` for
    each input row; ``key`` and ``nth`` tell rows apart as in ``with_row_key``."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    # a row's number depends on its content, so reruns and lost executors give the same draw
    base = checkpointed(with_row_key(plain).withColumn("row", F.xxhash64("key", "nth")))
    targets = source_targets(base.select("source", "size"), weights, most)
    # one row per source meets all documents: broadcast if they are counted to be few, else Spark splits the hot source
    small = F.broadcast if targets.count() <= MOST_BROADCAST else (lambda t: t)
    aimed = base.join(small(targets.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the documents no larger than the target are drawn; of the others only the smallest can come nearer, and only alone
    fits = F.col("size") <= F.col("target")
    alone = F.min(F.when(~fits, F.struct("size", F.xxhash64("row", F.lit(seed)).alias("order"), "row"))).alias("alone")
    eligible = aimed.groupBy(F.col("source").alias("s")).agg(F.sum(F.when(fits, F.col("size"))).alias("fitting"), alone)
    rated = aimed.join(small(eligible), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(fits & (F.col("fitting") > 0), F.least(F.lit(float(most)), F.col("target") / F.col("fitting"))).otherwise(F.lit(0.0))
    rated = checkpointed(rated.withColumn("whole", F.floor(rate + F.lit(1e-12))).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0))))
    drawn = balanced_copies(rated.filter("p > 1e-9 and size > 0").select("source", "row", "size", "p", (F.lit(int(most)) - F.col("whole")).cast("int").alias("room")), block_rows, seed)
    copies = (F.col("whole") + F.coalesce(F.col("take"), F.lit(0))).cast("long")
    out = checkpointed(rated.join(drawn, "row", "left").withColumn("copies", copies))
    got = out.filter("alone is not null").groupBy(F.col("source").alias("s"), "target", "alone").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
    only = got.filter("alone.size - target < abs(got - target)").select("s", F.col("alone.row").alias("only"))
    out = out.join(small(only), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    out = out.withColumn("copies", F.when(F.col("only").isNull(), F.col("copies")).otherwise((F.col("row") == F.col("only")).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key", "nth")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken. Empty
    texts, of which any number adds no words, stay once."""
    copies = mix(docs, **parameters).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("nth", F.greatest("copies", (F.col("size") == 0).cast("long")).alias("n")))).alias("times")) \
        .withColumnRenamed("key", "k")
    own = docs.select(whole_row(docs).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    keyed = with_row_key(own).select("own", "key", "nth")
    times = F.element_at("times", F.col("nth"))["n"].cast("int")
    out = keyed.join(copies, F.col("key") == F.col("k")).withColumn("times", times).filter("times > 0")
    return out.select("own", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("own.*")


