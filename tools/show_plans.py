"""Write the physical plans of the headline queries to PLANS.md.

    python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkdod.plans.catalog import QUERIES  # noqa: E402
from sparkdod.session import get_spark  # noqa: E402

SHOW = ["window_outlier_counts_time", "window_outliers_count", "neighbor_profile_fine", "radius_pairs", "knn_two_tables", "knn_within", "rank_limit", "dense_clusters"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    out = ["# Physical plans", "",
           "Generated by `tools/show_plans.py` on %s (local[8], 8 shuffle partitions). Plans are the" % sf,
           "adaptive plans after execution: shuffles (`Exchange`), window partitioning, pushed filters and",
           "read schemas of the scans. Eager steps (checkpoint of the distinct table, quantile bounds,",
           "principal axes) run before the plan and appear as `Scan ExistingRDD` / literals.", ""]
    for name in SHOW:
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        out += [f"## {name}", "", "```", plan.strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
