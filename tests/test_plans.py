"""Plan guards: no registered query may contain a cross join or a nested-loop
join, and the 1-D counting window must be split by value cell."""

import pytest

import __spark_entry__ as E
from sparkdod.plans.catalog import QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _executed_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith("stream_")))
def test_no_cross_or_nested_loop_join(spark, sf001, name):
    plan = _executed_plan(E.queries()[name](spark, sf001))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans a {op}"


def test_count_window_partitioned_by_slide_and_cell(spark, sf001):
    from sparkdod.operators.outliers import window_outlier_counts
    from sparkdod.plans.catalog import TIME_WINDOWS, events
    # with one cell per slide (small inputs) Spark drops the constant key, so pin four
    plan = _executed_plan(window_outlier_counts(events(spark, sf001), TIME_WINDOWS, 5.0, 10, cells=4))
    assert "windowspecdefinition(q#" in plan and "cell#" in plan.split("windowspecdefinition(q#", 1)[1].split(")", 1)[0]
