
import re

from transitreach.catalog.registry import QUERIES

# checked for every registered query in test_oracle.py
SLOW_PATHS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_legs_shuffles_only_the_per_trip_rows(spark, sf_small):
    plan = physical(QUERIES["clean_legs"][0](spark, sf_small))
    # partial aggregation to one row per trip, two windows over those rows, one join back
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 3, plan
    assert "Window" in plan


def test_dashboard_filters_reach_the_scan(spark, sf_small):
    df = QUERIES["accessibility_selected"][0](spark, sf_small)
    text = physical(df)
    scans = [line for line in df._jdf.queryExecution().toString().split("\n") if "PushedFilters" in line]
    assert any("LessThanOrEqual(t_time" in line for line in scans), scans
    assert "BroadcastHashJoin" in text or "BroadcastExchange" in text
