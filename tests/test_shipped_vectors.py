"""FLOAT vectors go to the blocks as they are, with the results of DOUBLE ones."""

import random

from sparkdod.operators.search import _axis_grid, radius_join, snapshot_outliers_nd


def test_float_vectors_are_shipped_as_floats(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)][: 6 - (i % 9 == 0)]) for i in range(150)] + [(200, None), (201, [float("nan")] * 6)]
    floats = spark.createDataFrame(rows, "id long, vec array<float>")
    doubles = floats.withColumn("vec", floats.vec.cast("array<double>"))
    q, d, _ = _axis_grid(floats, doubles, 1.5, "id", "vec", [], 2)
    assert q.schema["qvec"].dataType.simpleString() == "array<float>" and d.schema["dvec"].dataType.simpleString() == "array<double>"
    want = sorted(map(tuple, radius_join(doubles, doubles, 1.5, include_self=False).collect()))
    assert want and sorted(map(tuple, radius_join(floats, floats, 1.5, include_self=False).collect())) == want
    assert sorted(map(tuple, radius_join(floats, doubles, 1.5, include_self=False).collect())) == want
    assert sorted(map(tuple, snapshot_outliers_nd(floats, 1.5, 3).collect())) == sorted(map(tuple, snapshot_outliers_nd(doubles, 1.5, 3).collect()))
