"""Registered queries equal their SQL, and the plans are the ones meant for large input."""

import re

import pytest
from oracle import compare, entry_module

from tidepane import SUM, WindowSpec
from tidepane.operators import accepted, build_panes, window_versions, with_progress
from tidepane.plans import catalog
from tidepane.plans.catalog import SPEC, load
from tidepane.plans.sliding import sliding_panes

SMALL = "/root/testdata/sf0.001"
BASE = [
    "parse_lines", "parse_documented_lines", "line_replay", "event_progress", "late_accepted",
    "late_dropped", "null_rows_audit", "slide_epoch_assign", "pane_partials", "current_geomean", "current_product",
    "current_custom_agg", "revised_std", "window_versions", "final_windows", "lead_in_windows",
    "nondivisible_window", "long_window_versions", "long_window_final", "densified_windows", "flushed_windows", "keyed_windows",
    "keyed_origin_first", "tumbling_windows", "native_windows", "format_current", "stream_exact",
    "stream_upsert", "stream_lines_exact", "stream_messages", "stream_upsert_late", "partitioned_arrivals", "progress_sparse", "current_std_double", "revised_std_double",
]


@pytest.mark.parametrize("name", BASE)
def test_query_equals_sql(spark, name):
    rows, reason = compare(spark, SMALL, name)
    assert reason is None and rows > 0


def test_every_query_has_sql(spark):
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return re.findall(r"Exchange (\w+)\(?([^,)]*)", plan)


def test_progress_shuffles_rows_once_and_prunes_columns(spark):
    plan = plan_of(build_panes(accepted(with_progress(load(spark, SMALL), SPEC), SPEC), SPEC, [SUM]))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas.count("event_id:bigint,ts:timestamp_ntz,value:double") == 1
    assert set(schemas) <= {"event_id:bigint,ts:timestamp_ntz,value:double", "event_id:bigint,ts:timestamp_ntz"}
    # Rows are exchanged by arrival bucket, never as a whole into one partition: the only
    # single-partition step is above two levels of buckets.
    before_single = plan.split("Exchange SinglePartition")[1]
    assert "_bucket1" in before_single.split("FileScan")[0]
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_windows_from_panes_need_two_shuffles(spark):
    panes = sliding_panes(load(spark, SMALL), SPEC, [SUM])
    plan = plan_of(window_versions(panes, SPEC, [SUM], emitted_at=False))
    assert len(exchanges(plan)) == 2
    assert "_block" in plan and "hashpartitioning(w" in plan


def test_long_windows_shuffle_panes_not_copies(spark):
    longer = WindowSpec.of("12 h", "2 min", "24 min")
    panes = sliding_panes(load(spark, SMALL), longer, [SUM])
    plan = plan_of(window_versions(panes, longer, [SUM], emitted_at=False))
    # Two merges over intervals (windows closing, windows revised) and one by window.
    assert len(exchanges(plan)) == 3
    assert plan.count("_side") > 0
