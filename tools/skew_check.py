"""Skew check: one value holds a third of the rows and one day holds a
third of the rows; runs the flagship count with Spark's event log in the
given scratch folder. Analyse with tools/task_skew.py <folder>."""
import sys, time, json, glob, os; sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import numpy as np, pandas as pd
from sparkdod.session import get_spark
from sparkdod.operators.windows import Windows
from sparkdod.operators.outliers import window_outlier_counts
from pyspark.sql import functions as F
RUN = sys.argv[1] if len(sys.argv) > 1 else __import__("tempfile").mkdtemp(prefix="skew-")
spark = get_spark("local[8]", shuffle_partitions=16, spark__eventLog__enabled="true", spark__eventLog__dir=RUN)
spark.sparkContext.setLogLevel("ERROR")
rng = np.random.default_rng(0)
n = 600_000
vals = np.round(rng.gamma(2.0, 25.0, n), 2)
vals[: n // 3] = 42.0                                   # one hot value: a third of all rows
day = 86_400_000_000
ts = rng.integers(0, 30 * day, n)
ts[n // 3: 2 * n // 3] = 5 * day + rng.integers(0, day, n // 3)   # one hot day: a third of all rows
pdf = pd.DataFrame({"id": np.arange(n), "value": vals, "ts": pd.to_datetime(ts, unit="us")})
path = os.path.join(RUN, "skew.parquet"); pdf.to_parquet(path, row_group_size=50_000, coerce_timestamps="us")
pts = spark.read.parquet(path)
t = time.time()
res = window_outlier_counts(pts, Windows.time("2 days", "1 day"), 0.45, 50, cells=16).orderBy("window_end").collect()
print("rows", len(res), "outliers", sum(r.outliers for r in res), "sec", round(time.time() - t, 1))
spark.stop()
