"""Joins whose both sides grow with the tables send neither through the driver."""

import pytest

from clausemill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["highlight_segments", "merge_plain_segments"])
def test_segments_broadcast_nothing(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rank_exposure_aware", "rank_severity_baseline", "ablation_four_arms"])
def test_exposures_are_not_broadcast(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_arms_match_signals_once(spark):
    plan = catalog.QUERIES["ablation_four_arms"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in x for x in plan.splitlines()) == 4  # orders, lines, parts, customers
