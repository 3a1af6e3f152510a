"""sparkdod: distance-based outlier detection and neighbour search on Spark.

Main entry points::

    from sparkdod import Windows, window_outlier_counts, window_outliers, neighbor_profile
    from sparkdod import radius_join, knn_join, knn_within, rank_by_distance, nearest_center
    from sparkdod import parse_points, points_from_table, read_text_points
"""

import sys as _sys

# Ship this package's functions inside the pickled UDF closures, so Python
# workers need not have the package on their path (cluster executors, or a
# driver started outside the repository).
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

from .operators.clusters import assign_clusters, dense_clusters  # noqa: E402
from .operators.outliers import (neighbor_profile, outliers_per_cell, recent_neighbors,  # noqa: E402
                                 snapshot_outliers, window_outlier_counts, window_outlier_lines, window_outliers)
from .operators.sampling import extremes, sample_n  # noqa: E402
from .operators.search import (count_neighbors, knn_join, knn_within, nearest_center, radius_join,  # noqa: E402
                               rank_by_distance, snapshot_outliers_nd)
from .operators.windows import Windows, count_based_time, time_windows  # noqa: E402
from .sources.points import lines_from_table, parse_points, points_from_table, read_text_points  # noqa: E402
from .streaming.outliers import run_stream_outlier_counts, stream_outlier_counts  # noqa: E402

__all__ = ["Windows", "window_outlier_counts", "window_outliers", "neighbor_profile", "recent_neighbors",
           "outliers_per_cell", "snapshot_outliers", "window_outlier_lines", "radius_join", "knn_join",
           "knn_within", "rank_by_distance", "nearest_center", "count_neighbors", "snapshot_outliers_nd",
           "dense_clusters", "assign_clusters", "extremes", "sample_n", "count_based_time", "time_windows",
           "parse_points", "points_from_table", "read_text_points", "lines_from_table", "stream_outlier_counts",
           "run_stream_outlier_counts"]
