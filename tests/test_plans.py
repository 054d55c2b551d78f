"""Properties of physical plans that matter on large tables."""

import re
from pathlib import Path

import pytest

from checks.registry import CHECKS

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="benchmark tables are not here")
BY_NAME = {c.name: c for c in CHECKS}


def _plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # print the pushed filters in full
    return BY_NAME[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["daily_sales", "ads_master", "period_comparison", "all_orders", "upsert_orders", "scalar_currency", "content_platform_metrics"]
)
def test_no_python_and_no_nested_loops(spark, name):
    plan = _plan(spark, name)
    assert not re.search("EvalPython|MapInPandas|MapInArrow|NestedLoop|CartesianProduct", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(spark, "period_filter")
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(o_orderdate", plan)
    assert re.search(r"PushedFilters: .*In\(o_orderstatus", plan)
    assert "l_tax" not in plan and "o_custkey" not in plan


def test_distinct_orders_need_no_shuffle_after_the_order_join(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = _plan(spark, "gmv_quantiles")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan
    assert not re.search(r"hashpartitioning\([^)]*Order_Date_Only[^)]*Order_ID", plan)


@pytest.mark.parametrize("name", ["hero_kpis", "period_comparison", "hero_comparison"])
def test_date_filters_reach_the_scan(spark, name):
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(o_orderdate", _plan(spark, name))


def test_stored_orders_skip_months(spark):
    assert re.search(r"PartitionFilters: \[[^\]]*Month[^\]]*>= 2000-01", _plan(spark, "stored_orders"))
