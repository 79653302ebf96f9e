"""Plans: what reaches the scan, and what is not shuffled."""

import os

import pytest

import __spark_entry__ as entry
from canopy.plans import QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="provided tables not found")


def plan(spark, name):
    return entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_rule_filter_and_columns_reach_the_scan(spark):
    text = plan(spark, "event_rule")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" in text


@pytest.mark.parametrize(
    "name", ["event_rule", "for_pairs", "case_empty", "list_ops", "string_ops", "bool_ops", "span_slice", "span_location", "print_rules"]
)
def test_rowwise_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["event_case", "case_type", "analyze_rules", "kind_census"])
def test_aggregates_combine_before_their_only_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange") == 1 and "partial_" in text


def test_one_scan_per_table_for_a_rule_set(spark):
    assert plan(spark, "analyze_rules").count("FileScan") == 2  # orders and events


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_holds_nothing_that_does_not_scale(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert ("MapInPandas" in text) == (name == "html_tree_links")
    # The only window runs over one row per sort task.
    assert all("_task#" in line for line in text.splitlines() if "Window [" in line)
