"""Scaling check: the flagship count (2-day windows sliding 1 day, R=5, k=10)
on synthetic events-like points (two-decimal gamma values, 30 days) of
growing size, written to the given scratch folder.

    python tools/scale_check.py <scratch_dir> [n1 n2 ...] [--continuous]

``--continuous`` keeps full-precision values (distinct values ~ points);
otherwise values have two decimals like the events table.
"""

from __future__ import annotations

import os
import sys
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkdod.operators.outliers import window_outlier_counts  # noqa: E402
from sparkdod.operators.windows import Windows  # noqa: E402
from sparkdod.session import get_spark  # noqa: E402


def make(path: str, n: int, seed: int = 0, continuous: bool = False) -> None:
    rng = np.random.default_rng(seed)
    day = 86_400_000_000
    chunk = 2_000_000
    writer = None
    for start in range(0, n, chunk):
        m = min(chunk, n - start)
        ids = np.arange(start, start + m, dtype=np.int64)
        ts = np.sort(rng.integers(0, 30 * day, m)) + 1_704_067_200_000_000
        vals = rng.gamma(2.0, 25.0, m)
        if not continuous:
            vals = np.round(vals, 2)
        t = pa.table({"id": ids, "ts": pa.array(ts, pa.timestamp("us")), "value": vals})
        writer = writer or pq.ParquetWriter(path, t.schema)
        writer.write_table(t, row_group_size=500_000)
    writer.close()


def main() -> None:
    scratch = sys.argv[1]
    continuous = "--continuous" in sys.argv
    sizes = [int(x) for x in sys.argv[2:] if x.isdigit()] or [1_000_000, 4_000_000, 16_000_000]
    spark = get_spark("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    for n in sizes:
        path = os.path.join(scratch, f"points_{n}{'_c' if continuous else ''}.parquet")
        make(path, n, continuous=continuous)
        pts = spark.read.parquet(path)
        t = time.perf_counter()
        rows = window_outlier_counts(pts, Windows.time("2 days", "1 day"), 5.0, 10).collect()
        sec = time.perf_counter() - t
        print(f"n={n} windows={len(rows)} outliers={sum(r.outliers for r in rows)} sec={sec:.1f} "
              f"us_per_point={sec / n * 1e6:.2f}", flush=True)


if __name__ == "__main__":
    main()
