"""What the physical plans must and must not hold, whatever the size of the data."""

from __future__ import annotations

import re

import pytest
from helpers import day, moment, skewed, tables

import __spark_entry__ as registry
from firstmonth import schemas
from firstmonth.operators import friction, quality, tools, views
from firstmonth.operators.day_zero import measure, onboarding_start_dates
from firstmonth.plans.dashboard import build_dashboard
from firstmonth.plans.first_month import prepare
from firstmonth.sources import saved
from firstmonth.sources.event_mapping import map_events, read_events
from firstmonth.sources.tables import load_tables

SF = "/root/testdata/sf0.001"
WRITES = {"append_tool_usage", "clear_tables"} | {
    n for n in registry.queries() if n.startswith(("csv_import", "append_"))
}


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture
def uploads(spark):
    return map_events(read_events(spark, SF))


OWN = {n for n in registry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}  # without the training-data package


@pytest.mark.parametrize("name", sorted(OWN - WRITES))
def test_no_python_and_no_unbounded_operators(spark, capsys, name):
    text = plan(registry.queries()[name](spark, SF), capsys)
    for operator in ("Python", "Pandas", "CartesianProduct", "NestedLoopJoin", "ObjectHashAggregate"):
        assert operator not in text, operator
    if not name.endswith("friction_ranked"):  # its window runs over one row per friction point
        assert "Window" not in text


def test_filters_and_columns_reach_the_scan(spark, uploads, capsys):
    text = plan(tools.tool_kpis(prepare(uploads).tables.tool_usage), capsys)
    assert "In(event_type, [click,error,view])" in text.replace("'", "")
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value", text)
    assert "props" not in text


def test_large_tables_are_joined_without_a_shuffle_when_day_zero_fits(spark, uploads, capsys):
    text = plan(prepare(uploads).tables.tool_usage, capsys)
    assert "BroadcastHashJoin" in text
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1  # deduplication
    # Copies are merged before that shuffle.
    assert len(re.findall(r"^\(\d+\) HashAggregate", text, re.M)) == 2


def test_heavy_employees_are_never_shuffled_by_employee(spark, capsys):
    month = prepare(skewed(spark, "/root/testdata/sf0.01"), broadcast_bytes=10_000, heavy_rows=50)
    assert not month.day_zero.fits_broadcast and month.day_zero.most_rows > month.day_zero.heavy_threshold
    text = plan(month.tables.tool_usage, capsys)
    assert "SortMergeJoin" in text and "LeftAnti" in text
    assert "Union" in text
    keys = re.findall(r"Arguments: hashpartitioning\((.*?), \d+\)", text)
    # Both sides of the merge join; the deduplication of the light part reuses that partitioning.
    assert sorted(len(key.split(", ")) for key in keys)[:2] == [1, 1]
    assert len(keys) == 3


def test_without_heavy_employees_the_table_is_read_once(spark, uploads, capsys):
    zero = prepare(uploads, broadcast_bytes=1000).day_zero
    assert not zero.fits_broadcast and zero.most_rows <= zero.heavy_threshold
    text = plan(prepare(uploads, broadcast_bytes=1000).tables.tool_usage, capsys)
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) == 1
    assert "SortMergeJoin" in text and "Union" not in text


def test_friction_merges_per_employee_before_grouping(spark, uploads, capsys):
    text = plan(friction.friction_points(prepare(uploads).tables), capsys)
    for key in ("onboarding_stage", "tool_name", "request_category"):
        assert re.search(rf"hashpartitioning\({key}#\d+, employee_id#\d+, \d", text), key
    assert "Expand" not in text


def test_audit_shuffles_each_table_once(spark, uploads, capsys):
    text = plan(quality.audit(uploads), capsys)
    assert len(re.findall(r"Arguments: hashpartitioning", text)) == 3


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns[0] == "friction_point" and df.count() > 0


def test_date_bounds_reach_the_scan_of_stored_tables(spark, tmp_path, capsys):
    onb = [("a", "S", "Delayed", day(0), None), ("b", "S", "Delayed", day(100), None)]
    usage = [(e, "T", moment(n), "Failed") for e in "ab" for n in (-3, 0, 5, 101, 140, 400)]
    for name, df in tables(spark, onb=onb, tool=usage).items():
        df.write.parquet(f"{tmp_path}/{name}")
    stored = load_tables(spark, str(tmp_path))
    starts = measure(onboarding_start_dates(stored.onboarding))
    assert (starts.first_day, starts.last_day) == (day(0), day(100))
    view = views.first_30_days_tool_usage(stored.tool_usage, starts)
    assert sorted((r.employee_id, r.days_since_joining) for r in view.collect()) == [("a", 0), ("a", 5), ("b", 1)]
    text = plan(view, capsys)
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    assert "GreaterThanOrEqual(usage_date,2026-01-05T00:00)" in pushed
    assert "LessThan(usage_date,2026-05-16T00:00)" in pushed


@pytest.mark.parametrize("stage", [None, "Stage-3"])
def test_dashboard_computes_each_cleaned_table_once(spark, uploads, capsys, monkeypatch, stage):
    written = []
    save = saved.save
    monkeypatch.setattr(saved, "save", lambda df, name, **counts: written.append((name, df)) or save(df, name, **counts))
    board = build_dashboard(uploads, stage)
    assert [name for name, _ in written] == [f"merged-{t}" for t in schemas.TABLE_NAMES] + ["cohort"] * bool(stage)
    for name, df in written[:3]:
        assert len(re.findall(r"^\(\d+\) Scan parquet", plan(df, capsys), re.M)) == 1, name
    for name, df in board.frames().items():
        text = plan(df, capsys)
        assert "events.parquet" not in text, name
        if name.startswith(("tools", "support")):
            assert re.search(r"Location: .*merged-(tool_usage|support_requests)-", text), name


def test_overlap_joins_after_merging_per_employee(spark, uploads, capsys):
    t = prepare(uploads).tables
    tree = plan(tools.tool_support_overlap(t.tool_usage, t.support_requests), capsys)
    tree = tree[: tree.index("(1) ")]
    assert "LeftSemi" not in tree
    # Going up the tool branch: window join, deduplication, merge per tool and employee, overlap join.
    nodes = re.findall(r"(HashAggregate|Join)", tree)
    assert nodes[0:2] == ["HashAggregate", "HashAggregate"] and nodes[2] == "Join"
    assert nodes[3:7] == ["HashAggregate"] * 4 and nodes[7] == "Join"
