"""Cells of the count engine hold values and thresholds in equal shares."""

from pyspark.sql import functions as F

from sparkdod.operators.cells import with_cell
from sparkdod.operators.neighbors import union_bounds
from sparkdod.operators.outliers import window_outlier_counts
from sparkdod.operators.windows import Windows


def test_thresholds_outside_the_values_spread(spark):
    d = spark.range(20_000).select((F.col("id") / 20_000).alias("value"))
    bounds = union_bounds(d, 2.0, 16)
    keys = with_cell(d.select(F.explode(F.array("value", F.col("value") - 2, F.col("value") + 2)).alias("key")), "key", bounds)
    sizes = [r["count"] for r in keys.groupBy("cell").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_many_slides_per_window(spark):
    rows = [(i, float(i * 37 % 50)) for i in range(600)]
    got = {r.window_end: r.outliers for r in window_outlier_counts(spark.createDataFrame(rows, "id long, value double"), Windows.count(120, 2), 1.0, 6).collect()}
    for e, n in got.items():
        inside = [v for i, v in rows if (e - 60) * 2 <= i < e * 2]
        assert n == sum(sum(abs(u - v) <= 1.0 for u in inside) - 1 < 6 for v in inside)


def test_exact_bounds(spark):
    from sparkdod.operators.cells import exact_bounds
    frame = lambda vals: spark.createDataFrame([(v,) for v in vals], "value double")
    values = [float(i * 37 % 101) for i in range(350)] + [5.0] * 200 + [-0.0, 0.0]
    for n in (2, 3, 7, 40):
        ranked = sorted(values)
        want = sorted({ranked[-(-i * len(values) // n) - 1] for i in range(1, n)})
        assert exact_bounds(frame([*values, float("nan"), float("inf"), None]), "value", n) == want
    assert exact_bounds(frame([]), "value", 4) == [] and exact_bounds(frame([1.0]), "value", 1) == []
    assert exact_bounds(frame([2.0] * 9), "value", 4) == [2.0]
