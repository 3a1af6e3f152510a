"""n-D check: clustered 64-d vectors; times outlier counting with witness
pruning (k given) against full neighbour counts, and kNN.

    python tools/nd_scale_check.py <scratch_dir> [n1 n2 ...]
"""

from __future__ import annotations

import os
import sys
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkdod.operators.search import count_neighbors, knn_join  # noqa: E402
from sparkdod.session import get_spark  # noqa: E402


def make(path: str, n: int, dims: int = 64, clusters: int = 10, seed: int = 0) -> None:
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1.0, (clusters, dims))
    label = rng.integers(0, clusters, n)
    vec = (centers[label] + rng.normal(0, 0.1, (n, dims))).astype(np.float32)
    vec[: n // 100] = rng.normal(0, 1.0, (n // 100, dims))  # 1 % scattered points
    t = pa.table({"id": np.arange(n, dtype=np.int64),
                  "vec": pa.array(list(vec), pa.list_(pa.float32()))})
    pq.write_table(t, path, row_group_size=50_000)


def timed(label, fn):
    t = time.perf_counter()
    out = fn()
    print(f"{label}: {time.perf_counter() - t:.1f} s -> {out}", flush=True)


def main() -> None:
    scratch = sys.argv[1]
    sizes = [int(x) for x in sys.argv[2:]] or [20_000, 50_000]
    spark = get_spark("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    for n in sizes:
        path = os.path.join(scratch, f"vec_{n}.parquet")
        make(path, n)
        v = spark.read.parquet(path)
        print(f"n={n}", flush=True)
        timed("  outliers (R=1.0, k=5, witness pruning)",
              lambda: count_neighbors(v, 1.0, 5).where("neighbors < 5").count())
        timed("  full neighbour counts (R=1.0)", lambda: count_neighbors(v, 1.0).where("neighbors < 5").count())
        timed("  kNN k=5", lambda: knn_join(v, v, 5).count())


if __name__ == "__main__":
    main()
