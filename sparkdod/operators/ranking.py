"""Global numbering and 1-D kNN by rank, without a single-task sort.

Rows are range-partitioned by all order columns (a hot value is split by its
ids), numbered inside each partition and shifted by the sizes of the earlier
partitions (a table of one row per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.partitioning import materialize

# rows that one numbered partition holds at most, about
ROWS_PER_PARTITION = 1_000_000


def numbered(df: DataFrame, *order: Column | str, out_col: str = "rank", weight: Column | None = None) -> DataFrame:
    """``df`` with a LONG running number (1, 2, ...) by ``order``; with
    ``weight`` the running sum of that column up to and including the row."""
    spark = df.sparkSession
    df = materialize(df)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // ROWS_PER_PARTITION))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    one = F.lit(1) if weight is None else weight
    sizes = placed.groupBy("__part").agg(F.sum(one).cast("long").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumn("__run", F.sum(one).over(inside)).join(F.broadcast(offsets), "__part")
    return out.withColumn(out_col, (F.col("__run") + F.col("__off")).cast("long")).drop("__part", "__run", "__off")


# queries at one position from which on they get a copy of its objects, not a place in a join by position
HOT_QUERIES = 100_000


def _pairs_by_rank(queries: DataFrame, data: DataFrame, k: int, include_self: bool, keys: Sequence[str] = ()) -> DataFrame:
    """The candidates of every query row: (row, keys..., query_id, neighbor_id, distance) from (keys..., query_id, qv) and
    (keys..., neighbor_id, dv); ``k`` answers of a row are among them.

    The objects below a query, largest first, and those from it upwards,
    smallest first, are two runs of positions in the sorted objects; ``k`` of
    each run (one more for every object that has the query's own id, when that is skipped) hold the answer.
    Positions are joined as keys, so a query costs ``2k`` rows wherever it
    lies, and a value with many copies is read by id. ``keys`` come first in both orders, and
    positions of other keys are left out. Where very many queries share a position (all beyond the
    last object, say), its few objects are copied to them."""
    keys, kinds = list(keys), {f.name: f.dataType for f in [*queries.schema.fields, *data.schema.fields]}
    none = {c: F.lit(None).cast(kinds[c]).alias(c) for c in ("query_id", "neighbor_id")}
    both = data.select(*keys, "dv", F.lit(1).alias("is_data"), "neighbor_id", none["query_id"]) \
        .unionByName(queries.select(*keys, F.col("qv").alias("dv"), F.lit(0).alias("is_data"), none["neighbor_id"], "query_id"))
    # queries stand before equal objects: their running count is the number of smaller objects
    up = materialize(numbered(both, *keys, "dv", "is_data", "neighbor_id", "query_id", out_col="pos", weight=F.col("is_data"))
                     .withColumn("row", F.monotonically_increasing_id()))
    n = up.agg(F.sum("is_data")).first()[0] or 0
    its = [F.col(c).alias(f"__{c}") for c in keys]
    objects = up.where("is_data = 1").select(*its, "neighbor_id", "dv", "pos")
    down = numbered(objects.drop("pos"), *[F.col(f"__{c}").desc() for c in keys], F.col("dv").desc(), "neighbor_id", out_col="pos")
    asked = up.where("is_data = 0").select("row", *keys, "query_id", F.col("dv").alias("qv"), F.col("pos").alias("below"), F.lit(k).cast("long").alias("take"))
    if not include_self:
        copies = materialize(objects.groupBy("neighbor_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
        if copies.isEmpty():
            asked = asked.withColumn("take", F.lit(k + 1).cast("long"))
        else:
            asked = asked.join(copies, F.col("query_id") == F.col("neighbor_id"), "left").drop("neighbor_id") \
                .withColumn("take", F.lit(k) + F.coalesce("copies", F.lit(1))).drop("copies")
    hot = materialize(asked.groupBy("below").agg(F.count(F.lit(1)).alias("n"), F.max("take").alias("most")).where(F.col("n") > HOT_QUERIES).select("below", "most"))
    crowded = not hot.isEmpty()  # one row for HOT_QUERIES queries, so it may be broadcast
    single = asked.join(F.broadcast(hot.select("below")), "below", "left_anti") if crowded else asked
    pairs = None
    for side, start in ((objects, F.col("below")), (down, F.lit(n) - F.col("below"))):
        steps = F.explode(F.sequence(F.lit(1).cast("long"), "take")).alias("step")
        found = single.select(*single.columns, steps).withColumn("pos", start + F.col("step")).drop("below", "take", "step").join(side, "pos").drop("pos")
        pairs = found if pairs is None else pairs.unionByName(found)
        if crowded:
            near = hot.select("below", F.explode(F.sequence(F.lit(1).cast("long"), "most")).alias("step")).withColumn("pos", start + F.col("step")).join(side, "pos").drop("pos")
            pairs = pairs.unionByName(asked.join(F.broadcast(near), "below").where("step <= take").drop("below", "take", "step"))
    for c in keys:
        pairs = pairs.where(F.col(c) == F.col(f"__{c}"))
    if not include_self:
        pairs = pairs.where(F.col("query_id") != F.col("neighbor_id"))
    return pairs.select("row", *keys, "query_id", "neighbor_id", F.abs(F.col("qv") - F.col("dv")).alias("distance"))


def knn_by_rank(queries: DataFrame, data: DataFrame, k: int, include_self: bool) -> DataFrame:
    """The ``k`` nearest numbers of every query, ties by object id:
    (query_id, neighbor_id, distance, rank) from (query_id, qv) and
    (neighbor_id, dv). Every query row has its own answers, also where ids
    of queries repeat."""
    w = Window.partitionBy("row").orderBy("distance", "neighbor_id")
    return _pairs_by_rank(queries, data, k, include_self).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("row")


def knn_within_by_rank(queries: DataFrame, data: DataFrame, k: int, radius: float, include_self: bool, keys: Sequence[str]) -> DataFrame:
    """The ``k`` nearest numbers with equal ``keys`` within ``radius``, ranked for every query id and keys:
    (query_id, neighbor_id, distance, keys..., rank)."""
    for c in keys:
        queries, data = queries.where(F.col(c).isNotNull()), data.where(F.col(c).isNotNull())
    if not include_self:  # an unknown id equals and differs from none
        queries, data = queries.where(F.col("query_id").isNotNull()), data.where(F.col("neighbor_id").isNotNull())
    w = Window.partitionBy("query_id", *keys).orderBy("distance", "neighbor_id")
    pairs = _pairs_by_rank(queries, data, k, include_self, keys).where(F.col("distance") <= F.lit(float(radius)))
    return pairs.select("query_id", "neighbor_id", "distance", *keys, F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
