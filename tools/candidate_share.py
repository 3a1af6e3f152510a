"""Share of all (query, object) pairs that the n-D grid and the pivots (kNN) leave as candidates.

    python tools/candidate_share.py [SF_DIR]

Prints it for the table ``embeddings`` and for clustered vectors made from it
(each vector moved by ten times a direction of its label)."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from sparkdod.functions.block_metrics import manhattan_blocks  # noqa: E402
from sparkdod.operators import metric_search  # noqa: E402
from sparkdod.operators.search import _axis_grid  # noqa: E402
from sparkdod.plans.catalog import K_ND, R_ND, vectors  # noqa: E402
from sparkdod.session import get_spark  # noqa: E402


def share(points, radius: float) -> float:
    q, d, keys = _axis_grid(points, points, radius, "id", "vec", [], 2, None)
    n = points.count()
    pairs = q.groupBy(*keys).agg(F.count(F.lit(1)).alias("nq")).join(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("nd")), keys)
    return (pairs.agg(F.sum(F.col("nq") * F.col("nd"))).first()[0] or 0) / (n * n)


def pivot_share(points, k: int, ring_rows: int) -> float:
    """Rings of ``ring_rows`` objects, so that small tables have some."""
    metric_search.RING_ROWS = ring_rows
    objects = metric_search._points(points, "id", "vec")
    index = metric_search.build_index(objects, manhattan_blocks, k + 1)
    return index.candidate_pairs(index.visits(metric_search._numbered_objects(objects), None, k + 1)) / objects.count() ** 2


if __name__ == "__main__":
    spark = get_spark("local[4]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    v = vectors(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
    print("embeddings:", round(share(v, R_ND), 3))
    moved = F.transform(F.col("vec").cast("array<double>"), lambda x, i: x + F.sin(F.col("label") * 7 + i * 3) * 10)
    print("clustered:", round(share(v.withColumn("vec", moved), R_ND), 3))
    print("embeddings, pivots:", round(pivot_share(v, K_ND, 8), 3))
    print("clustered, pivots:", round(pivot_share(v.withColumn("vec", moved), K_ND, 8), 3))
