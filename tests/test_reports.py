from __future__ import annotations

import pytest
from helpers import by, day, moment, only, tables

from firstmonth.operators import friction, journey, merged, onboarding, overview, support, tools
from firstmonth.plans.dashboard import build_dashboard
from firstmonth.plans.first_month import prepare
from firstmonth.sources.event_mapping import map_events, read_events


def cleaned(spark, **rows):
    return prepare(tables(spark, **rows)).tables


def test_stage_summary_and_kpis(spark):
    t = cleaned(
        spark,
        onb=[("a", "S1", "Completed", day(0), day(1)), ("b", "S1", "Delayed", day(0), day(2)),
             ("c", "S1", "In Progress", day(0), None), ("a", "S2", "Delayed", day(1), None),
             ("a", None, "Completed", day(2), day(9)), ("b", "S3", None, day(3), None)],
    )
    summary = onboarding.stage_summary(t.onboarding).collect()
    assert [r.onboarding_stage for r in summary] == ["S1", "S2", "S3"]
    assert summary[0].asDict() == {
        "onboarding_stage": "S1", "total_assigned": 3, "completed_count": 1, "delayed_count": 1,
        "in_progress_count": 1, "avg_duration_days": 1.5, "delay_rate_pct": 33.33, "completion_rate_pct": 33.33,
    }
    assert summary[1].avg_duration_days == 0.0
    assert only(onboarding.onboarding_kpis(t.onboarding)) == {
        "total_employees": 3,
        "overall_completion_rate": 33.33,  # rows without a stage count here
        "top_delayed_stage": "S1",
        "top_longest_stage": "S1",
        "avg_onboarding_time_days": 1.5,
    }
    long = onboarding.stage_status_long(onboarding.stage_summary(t.onboarding))
    assert long.columns == ["onboarding_stage", "status_type", "count"]
    assert long.count() == 9
    assert [r[0] for r in onboarding.stage_list(t.onboarding).collect()] == ["S1", "S2", "S3"]


def test_onboarding_time_sums_rounded_averages(spark):
    # Averages 0.33, 0.33, 0.29 add up to 0.95; array rounding to one digit gives 1.0 (half to even).
    rows = [(f"e{i}", stage, "Completed", day(0), day(1 if i == 0 else 0))
            for stage, n in (("S1", 3), ("S2", 3), ("S3", 7)) for i in range(n)]
    rows = [(e, s, st, d, day(2) if s == "S3" and e == "e0" else c) for e, s, st, d, c in rows]
    t = cleaned(spark, onb=rows)
    averages = {r.onboarding_stage: r.avg_duration_days for r in onboarding.stage_summary(t.onboarding).collect()}
    assert averages == {"S1": 0.33, "S2": 0.33, "S3": 0.29}
    assert only(onboarding.onboarding_kpis(t.onboarding))["avg_onboarding_time_days"] == 1.0


def test_ties_go_to_the_lowest_name_and_least_used_to_the_highest(spark):
    t = cleaned(
        spark,
        onb=[(e, s, "Delayed", day(0), day(2)) for e in "ab" for s in ("S2", "S1")],
        tool=[("a", name, moment(i), "Failed") for name in ("T3", "T1", "T2") for i in (0, 1)],
        sup=[(str(i), "a", c, moment(0), "Closed", 5.0) for i, c in enumerate(("C2", "C1"))],
    )
    kpis = only(onboarding.onboarding_kpis(t.onboarding))
    assert (kpis["top_delayed_stage"], kpis["top_longest_stage"]) == ("S1", "S1")
    assert only(tools.tool_kpis(t.tool_usage)) == {
        "most_used_tool": "T1", "least_used_tool": "T3", "most_problematic_tool": "T1",
    }
    kpis = only(support.support_kpis(t.support_requests))
    assert (kpis["most_common_category"], kpis["slowest_category"]) == ("C1", "C1")


def test_tool_summary_counts_a_missing_status_as_failure(spark):
    t = cleaned(
        spark,
        tool=[("a", "T", moment(0), "Success"), ("a", "T", moment(1), None), ("b", "T", moment(0), "Timeout"),
              ("b", None, moment(0), "Failed"), ("c", "U", moment(0), "Success")],
        sup=[("1", "b", "C", moment(0), "Closed", 1.0)],
    )
    assert by(tools.tool_summary(t.tool_usage), "tool_name")["T"] == {
        "tool_name": "T", "total_usage_events": 3, "active_users": 2, "successful_events": 1,
        "failed_events": 2, "failure_rate_pct": 66.67,
    }
    assert by(tools.tool_support_overlap(t.tool_usage, t.support_requests), "tool_name") == {
        "T": {"tool_name": "T", "events_by_supported_employees": 1, "failed_events": 1}
    }
    kpis = only(tools.tool_kpis(t.tool_usage))
    assert (kpis["most_used_tool"], kpis["least_used_tool"], kpis["most_problematic_tool"]) == ("T", "U", "T")


def test_support_reports(spark):
    t = cleaned(
        spark,
        sup=[("1", "a", "C", moment(0), "Resolved", 3.0), ("2", "a", "C", moment(1), "Closed", None),
             ("3", "a", "C", moment(1), None, -4.0), ("4", "a", "D", moment(1), "Pending", 8.0),
             ("5", "b", None, moment(1), "Pending", 1.0)],
    )
    assert by(support.support_category_summary(t.support_requests), "request_category") == {
        "C": {"request_category": "C", "total_requests": 3, "unresolved_count": 2, "avg_resolution_hours": 1.0},
        "D": {"request_category": "D", "total_requests": 1, "unresolved_count": 1, "avg_resolution_hours": 8.0},
    }
    assert only(support.support_kpis(t.support_requests)) == {
        "total_requests": 5, "unresolved_requests": 4, "avg_resolution_hrs": 2.4,
        "most_common_category": "C", "slowest_category": "D",
    }
    # a asks three times about C (two repeats) and once about D (none).
    assert only(support.repeated_issues(t.support_requests)) == {"repeated_issues_count": 2}
    timeline = {tuple(r) for r in support.support_timeline(t.support_requests).collect()}
    assert timeline == {(0, "C", 1), (1, "C", 2), (1, "D", 1)}


def test_friction_scores_by_hand(spark):
    t = cleaned(
        spark,
        onb=[("a", "S", "Delayed", day(0), day(3)), ("b", "S", "Delayed", day(0), None),
             ("c", "S", "Completed", day(0), day(9)), ("a", "R", "Delayed", day(0), None)],
        tool=[("a", "T", moment(0), "Failed"), ("a", "T", moment(1), None), ("b", "T", moment(0), "Success"),
              ("b", "Fine", moment(0), "Success")],
        sup=[(str(i), e, "C", moment(i), "Closed", 6.25) for i, e in enumerate("abcdef")],
    )
    points = by(friction.friction_points(t), "friction_point")
    assert points.keys() == {
        "Onboarding Stage Delay: S", "Onboarding Stage Delay: R", "Tool Usage Failure: T", "Support Dependency: C",
    }
    stage = points["Onboarding Stage Delay: S"]
    assert stage["friction_score"] == round(2 * (2 / 3) * (1 + 3.0 / 5.0) * 10.0, 1)
    assert stage["impact_metric"] == "3.0 days average completion time"
    assert stage["evidence"] == "2 delayed stage assignments affecting 66.7% of new hires."
    assert points["Onboarding Stage Delay: R"]["impact_metric"] == "4.0 days average completion time"
    tool = points["Tool Usage Failure: T"]
    assert (tool["frequency"], tool["affected_employees"], tool["affected_pct"]) == (2, 1, 33.3)
    assert tool["impact_metric"] == "66.7% usage error rate"
    assert tool["friction_score"] == round(2 * (1 / 3) * (1 + 66.7 / 20.0) * 8.0, 1)
    assert tool["evidence"] == "2 failed/timeout access events across 33.3% of new hires."
    sup = points["Support Dependency: C"]
    assert sup["affected_pct"] == 200.0  # the share refers to employees with onboarding rows
    assert sup["impact_metric"] == "6.2 hours MTTR resolution time"  # 6.25 rounds half to even
    assert sup["evidence"] == "6 helpdesk requests logged with average resolution time of 6.2 hrs."
    assert sup["friction_score"] == round(6 * (6 / 3) * (1 + 6.2 / 12.0) * 9.0, 1)


def test_friction_order_rank_and_bottleneck(spark):
    t = cleaned(
        spark,
        sup=[(f"{c}{i}", f"e{i}", c, moment(0), "Closed", 1.0) for c in ("B", "A", "Z") for i in range(3 if c == "Z" else 2)],
    )
    points = friction.friction_points(t)
    assert [r.friction_point[-1] for r in points.collect()] == ["Z", "A", "B"]
    ranked = {r.friction_point[-1]: r.rank for r in friction.friction_ranked(points).collect()}
    assert ranked == {"Z": 1, "A": 2, "B": 3}
    best = only(friction.primary_bottleneck(points.orderBy("friction_score")))
    assert best["friction_point"] == "Support Dependency: Z"
    assert friction.friction_evidence(points).columns == [
        "friction_point", "frequency", "affected_pct", "impact_metric", "friction_score",
    ]


def test_journey(spark):
    days = [7, 8, 14, 22, 30]
    t = cleaned(
        spark,
        onb=[("a", "S", "Delayed", day(0), None)],
        sup=[(str(d), "a", "C", moment(d, 5), "Closed", 1.0) for d in days],
    )
    daily = by(journey.journey_daily(t), "days_since_joining")
    assert sorted(daily) == list(range(31))
    assert sorted(d for d, r in daily.items() if r["support_tickets"]) == days
    assert [d for d, r in daily.items() if r["onboarding_events"]] == [0]
    assert not any(r["tool_events"] for r in daily.values())
    weeks = journey.journey_weekly_tickets(t.support_requests).collect()
    assert sorted(map(tuple, weeks)) == [(1, 0, 7, 1), (2, 8, 14, 2), (3, 15, 21, 0), (4, 22, 30, 2)]


def test_daily_counts_add_up(spark):
    t = prepare(map_events(read_events(spark, "/root/testdata/sf0.001"))).tables
    rows = journey.journey_daily(t).collect()
    assert sum(r.onboarding_events for r in rows) == t.onboarding.count()
    assert sum(r.tool_events for r in rows) == t.tool_usage.count()
    assert sum(r.support_tickets for r in rows) == t.support_requests.count()


def test_overview(spark):
    t = cleaned(
        spark,
        onb=[("a", "S", "Completed", day(0), day(2)), ("b", "S", "Delayed", day(0), None)],
        sup=[("1", "a", "C", moment(0), "Closed", 1.0)],
    )
    assert only(overview.overview_kpis(t)) == {
        "total_hires": 2, "completion_rate": 50.0, "avg_completion_days": 2.0, "total_support_requests": 1,
        "most_common_issue": "C", "top_delayed_stage": "S", "most_problematic_tool": "N/A",
    }
    nameless = cleaned(spark, tool=[("a", None, moment(0), "Failed")])
    assert only(overview.overview_kpis(nameless))["most_problematic_tool"] == "None"


def test_empty_tables(spark):
    t = cleaned(spark)
    assert not t.has_rows()
    for empty in (
        onboarding.stage_summary(t.onboarding),
        onboarding.stage_list(t.onboarding),
        tools.tool_summary(t.tool_usage),
        tools.tool_support_overlap(t.tool_usage, t.support_requests),
        support.support_category_summary(t.support_requests),
        support.support_timeline(t.support_requests),
        friction.friction_points(t),
        friction.primary_bottleneck(friction.friction_points(t)),
    ):
        assert empty.count() == 0
    assert tuple(onboarding.onboarding_kpis(t.onboarding).first()) == (0, 0.0, "None", "None", 0.0)
    assert tuple(tools.tool_kpis(t.tool_usage).first()) == ("None", "None", "None")
    assert tuple(support.support_kpis(t.support_requests).first()) == (0, 0, 0.0, "None", "None")
    assert support.repeated_issues(t.support_requests).first()[0] == 0
    assert tuple(overview.overview_kpis(t).first()) == (0, 0.0, 0.0, 0, "N/A", "N/A", "N/A")
    assert journey.journey_daily(t).count() == 31
    assert journey.journey_weekly_tickets(t.support_requests).count() == 4
    assert build_dashboard(tables(spark)) is None


def single_reports(t):
    points = friction.friction_points(t)
    stages = onboarding.stage_summary(t.onboarding)
    return {
        "stage_list": onboarding.stage_list(t.onboarding),
        "overview_kpis": overview.overview_kpis(t),
        "overview_primary_bottleneck": friction.primary_bottleneck(points),
        "onboarding_kpis": onboarding.onboarding_kpis(t.onboarding),
        "onboarding_stage_summary": stages,
        "onboarding_stage_status": onboarding.stage_status_long(stages),
        "tools_kpis": tools.tool_kpis(t.tool_usage),
        "tools_tool_summary": tools.tool_summary(t.tool_usage),
        "tools_support_overlap": tools.tool_support_overlap(t.tool_usage, t.support_requests),
        "support_kpis": support.support_kpis(t.support_requests),
        "support_category_summary": support.support_category_summary(t.support_requests),
        "support_timeline": support.support_timeline(t.support_requests),
        "support_repeated_issues": support.repeated_issues(t.support_requests),
        "friction_points": points,
        "friction_evidence": friction.friction_evidence(points),
        "friction_ranked": friction.friction_ranked(points),
        "journey_daily": journey.journey_daily(t),
        "journey_weekly_tickets": journey.journey_weekly_tickets(t.support_requests),
    }


def same_rows(frame, single):
    assert frame.dtypes == single.dtypes
    assert sorted(map(str, frame.collect())) == sorted(map(str, single.collect()))


@pytest.mark.parametrize("stage", [None, "Stage-3"])
def test_dashboard_equals_the_single_reports(spark, stage):
    raw = map_events(read_events(spark, "/root/testdata/sf0.001"))
    board = build_dashboard(raw, stage)
    assert only(board.audit)["duplicate_records"] > 0
    assert board.stage_list.count() == 6
    first_month = prepare(raw)
    singles = single_reports((first_month.cohort(stage) if stage else first_month).tables)
    singles["stage_list"] = onboarding.stage_list(first_month.tables.onboarding)
    frames = board.frames()
    assert set(frames) == set(singles) | {"audit", "audit_warnings"}
    for name, single in singles.items():
        same_rows(frames[name], single)


def test_merged_rows_report_like_the_rows_themselves(spark):
    """Missing groups, statuses and dates, repeats on one day, hours no decimal holds, negative durations."""
    nan, inf = float("nan"), float("inf")
    onb = [
        (e, s, status, day(n), end)
        for e in ("a", "b")
        for s in ("S", "T", None)
        for n, status, end in [
            (0, "Delayed", None), (0, "Delayed", day(9)), (3, "Completed", day(1)), (3, None, day(4)), (30, "In Progress", None)
        ]
    ]
    tool = [
        (e, t, moment(n, hour), status)
        for e in ("a", "c")
        for t in ("X", "Y", None)
        for n, hour, status in [(0, 1, "Success"), (0, 2, "Failed"), (0, 2, "Failed"), (7, 0, None), (8, 0, "Timeout"), (31, 0, "Failed")]
    ]
    hours = [0.1, 0.2, 0.3, None, nan, -4.0, 1e22, 7.5]
    sup = [(f"r{e}{c}{i}", e, c, moment(i % 3, i), "Resolved" if i % 2 else None, h) for e in "ab" for c in ("K", None) for i, h in enumerate(hours)]
    sup += [("i1", "a", "L", moment(1), "Open", inf), ("i2", "b", "L", moment(2), "Resolved", 2.0)]
    t = prepare(tables(spark, onb, tool, sup)).tables
    m = merged.merge(t)
    assert all(a.count() < b.count() for (_, a), (_, b) in zip(m.items(), t.items()))
    frames = single_reports(m)
    for name, single in single_reports(t).items():
        same_rows(frames[name], single)
    empty = prepare(tables(spark)).tables
    frames = single_reports(merged.merge(empty))
    for name, single in single_reports(empty).items():
        same_rows(frames[name], single)
