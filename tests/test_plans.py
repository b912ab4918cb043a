"""Plan shape of the registered queries: no pair-producing joins, pruned scans."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from test_entry import core

SKIP = {"als_stationary", "als_model_checks", "als_recommend_top10", "als_similar_top10",
        "training_triples_roundtrip", "quota_daily_stream", "quota_daily_stream_runs", "list_pages_stream",
        "quota_late_stream", "quota_alarm_stream", "ratings_latest_stream"}


@pytest.mark.parametrize("key", sorted(core(E.queries()) - SKIP))
def test_no_cross_or_nested_loop_join(spark, key):
    plan = E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_ratings_scan_is_pruned_and_filtered(spark):
    plan = E.queries()["ratings_canonical"](spark, SF_SMALL)._jdf.queryExecution() \
        .executedPlan().toString()
    scan = [line for line in plan.split("\n") if "lineitem" in line][0]
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double>" in scan
    assert "GreaterThanOrEqual(l_quantity,5.0)" in scan
    assert "SortAggregate" not in plan          # the dedupe is a hash aggregate


def test_no_sort_aggregation_in_search(spark):
    plan = E.queries()["search_top10"](spark, SF_SMALL)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "SortAggregate" not in plan
    assert "WindowGroupLimit" in plan           # top 10 per query cut before the shuffle
