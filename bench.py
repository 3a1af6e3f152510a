"""Benchmark: run the headline queries at $BENCH_SF_DIR (default sf0.1) on
local[$BENCH_CPUS] and print one JSON line.

Every query is executed in full with the ``noop`` sink (no collect to the
driver); times are wall-clock seconds per query after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkdod.plans.catalog import QUERIES  # noqa: E402
from sparkdod.session import get_spark  # noqa: E402

HEADLINE = [
    "window_outlier_counts_time",
    "window_outlier_counts_count",
    "window_outliers_count",
    "neighbor_profile",
    "recent_neighbors",
    "snapshot_outliers_1d",
    "outliers_per_cell",
    "dense_clusters",
    "radius_pairs",
    "radius_join_nd",
    "snapshot_outliers_nd",
    "knn_5",
    "knn_within",
    "nearest_center",
    "orders_window_outlier_counts",
    "stream_outlier_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    conf = {}
    event_dir = os.environ.get("BENCH_EVENT_LOG")
    if event_dir:
        conf = {"spark__eventLog__enabled": "true", "spark__eventLog__dir": event_dir}
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus), spark__driver__memory="16g", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["window_outlier_counts_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
