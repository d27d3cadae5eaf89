from __future__ import annotations

import pytest
from helpers import by, day, moment, only, skewed, tables, tool_usage
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.operators import day_zero as dz
from firstmonth.operators import views
from firstmonth.operators.quality import deduplicate
from firstmonth.plans.first_month import prepare
from firstmonth.sources.event_mapping import map_events, read_events
from firstmonth.sources.tables import Tables

SF = "/root/testdata/sf0.01"


def test_day_zero_comes_from_any_table(spark):
    t = tables(
        spark,
        onb=[("onb", "S", "Completed", day(0), None), ("tool", "S", "Completed", day(5), None),
             ("sup", "S", "Completed", day(5), None), ("late", "S", "Completed", None, None)],
        tool=[("onb", "T", moment(2, 9), "Success"), ("tool", "T", moment(3, 23), "Success"),
              ("only", "T", moment(4, 1), "Success"), ("late", "T", moment(6, 1), "Success"),
              (None, "T", moment(0), "Success")],
        sup=[("1", "sup", "C", moment(2, 12), "Resolved", 1.0)],
    )
    got = {r.employee_id: r.joining_date for r in dz.day_zero(t).collect()}
    # An employee whose only start date is missing is found through the other tables.
    assert got == {"onb": day(0), "tool": day(3), "sup": day(2), "only": day(4), "late": day(6)}


def test_window_bounds_and_the_midnight_rule_of_the_views(spark):
    days = [moment(0), moment(30), moment(30, 0, 1), moment(30, 23), moment(31), moment(-1, 23)]
    t = tables(
        spark,
        onb=[("a", "S", "Completed", day(0), day(2)), ("a", "S", "Completed", day(30), day(28)),
             ("a", "S", "Completed", day(31), None)],
        tool=[("a", "T", at, "Success") for at in days[:5]],
    )
    cleaned = prepare(t).tables
    assert {r.usage_date for r in cleaned.tool_usage.collect()} == set(days[:4])
    durations = {r.days_since_joining: r.duration_days for r in cleaned.onboarding.collect()}
    assert durations == {0: 2, 30: -2}  # a completion before the start stays, as a negative duration

    # The views take Day 0 from onboarding, drop the day before it, and end Day 30 at midnight.
    usage = tool_usage(spark, *[("a", "T", at, "Success") for at in days])
    usage = usage.withColumn("usage_id", F.lit(1).cast("bigint"))
    starts = dz.measure(dz.onboarding_start_dates(t.onboarding))
    got = views.first_30_days_tool_usage(usage, starts).collect()
    assert {(r.usage_date, r.days_since_joining) for r in got} == {(days[0], 0), (days[1], 30)}


def test_views_need_onboarding_and_the_cleaned_path_does_not(spark):
    t = tables(spark, sup=[("1", "a", "C", moment(0, 8), "Resolved", 2.0)])
    starts = dz.measure(dz.onboarding_start_dates(t.onboarding))
    assert views.first_30_days_support(t.support_requests, starts).count() == 0
    assert only(prepare(t).tables.support_requests)["days_since_joining"] == 0


def test_resolution_time_is_normalised_after_deduplication(spark):
    t = tables(
        spark,
        sup=[("1", "a", "C", moment(0), "Resolved", h) for h in (None, None, -1.0, float("nan"), 0.0, 3.0)],
    )
    got = sorted(r.resolution_time for r in prepare(t).tables.support_requests.collect())
    # Only the exact copy goes; rows that merely become equal stay.
    assert got == [0.0, 0.0, 0.0, 0.0, 3.0]


def test_surrogate_keys_hide_copies_unless_ignored(spark):
    row = ("a", "T", moment(0), "Success")
    usage = tool_usage(spark, row, row).withColumn("usage_id", F.monotonically_increasing_id())
    usage = spark.createDataFrame(usage.collect(), usage.schema)
    t = tables(spark)
    t = Tables(t.onboarding, usage, t.support_requests)
    assert prepare(t).tables.tool_usage.count() == 2
    kept = only(prepare(t, ignore_keys=True).tables.tool_usage)
    assert kept["usage_id"] == min(r.usage_id for r in usage.collect())
    assert deduplicate(usage, ["usage_id"]).columns == usage.columns


def test_missing_optional_columns_get_defaults(spark):
    t = tables(
        spark,
        onb=[("a", "S", "Delayed", day(0), day(1))],
        tool=[("a", "T", moment(0), "Failed")],
        sup=[("1", "a", "C", moment(0), "Closed", 1.0)],
    )
    bare = Tables(
        t.onboarding.drop("stage_status", "completion_date"),
        t.tool_usage.drop("usage_status", "usage_activity"),
        t.support_requests.drop("request_id", "request_status", "resolution_time").withColumn("team", F.lit("x")),
    )
    cleaned = prepare(bare).tables
    row = only(cleaned.onboarding)
    assert (row["stage_status"], row["completion_date"], row["duration_days"]) == ("In Progress", None, None)
    row = only(cleaned.tool_usage)
    assert (row["usage_status"], row["usage_activity"]) == ("Success", "General Activity")
    row = only(cleaned.support_requests)
    assert (row["request_status"], row["resolution_time"], row["team"]) == ("Pending", 0.0, "x")


def test_text_columns_are_cast_and_bad_dates_raise(spark):
    rows = [("a", "S", "2026-01-05"), ("b", "S", "2026-01-06 10:30:00")]
    onb = spark.createDataFrame(rows, "employee_id string, onboarding_stage string, start_date string")
    t = tables(spark)
    cleaned = prepare(Tables(onb, t.tool_usage, t.support_requests)).tables.onboarding
    assert {r.employee_id: r.start_date for r in cleaned.collect()} == {"a": day(0), "b": day(1)}
    bad = onb.withColumn("start_date", F.lit("soon"))
    with pytest.raises(Exception, match="soon"):
        prepare(Tables(bad, t.tool_usage, t.support_requests))


def test_offsets_in_text_move_to_utc(spark):
    rows = [("a", "T", "2026-01-05T23:30:00-02:00"), ("a", "T", "2026-01-05 10:00:00")]
    usage = spark.createDataFrame(rows, "employee_id string, tool_name string, usage_date string")
    t = tables(spark)
    got = prepare(Tables(t.onboarding, usage, t.support_requests)).tables.tool_usage.collect()
    assert {r.usage_date for r in got} == {moment(1, 1).replace(minute=30), moment(0, 10)}


# ------------------------------------------------------------------ the ways of joining Day 0


def cleaned_rows(first_month):
    return {
        name: sorted(map(str, (r.asDict() for r in df.collect()))) for name, df in first_month.tables.items()
    }


def test_every_join_strategy_gives_the_same_rows(spark):
    t = skewed(spark, SF)
    broadcast = prepare(t)
    assert broadcast.day_zero.fits_broadcast
    everyone, cohort = cleaned_rows(broadcast), cleaned_rows(broadcast.cohort("Stage-3"))
    for heavy_rows in (1, 60, 10**9):  # by the bound, by the setting, none
        shuffled = prepare(t, broadcast_bytes=10_000, heavy_rows=heavy_rows)
        assert not shuffled.day_zero.fits_broadcast
        assert cleaned_rows(shuffled) == everyone
        assert cleaned_rows(shuffled.cohort("Stage-3")) == cohort


def test_the_heavy_list_fits_the_broadcast_bound(spark):
    zero = prepare(skewed(spark, SF), broadcast_bytes=3000, heavy_rows=1).day_zero
    heavy = zero.frame.filter(F.col("source_rows") > zero.heavy_threshold).count()
    assert zero.heavy_threshold > 1
    assert 1 <= heavy <= zero.source_rows / zero.heavy_threshold
    assert heavy * zero.largest_row_bytes <= 3000


def test_measured_size(spark):
    t = tables(spark, onb=[("ab", "S", "Delayed", day(0), None)] * 3, sup=[("1", "abcd", "C", moment(0), "Closed", 1.0)])
    zero = prepare(t).day_zero
    assert (zero.employees, zero.source_rows) == (2, 4)
    assert zero.size_bytes == 2 * 192 + 2 * (2 + 4)
    empty = prepare(tables(spark)).day_zero
    assert (empty.employees, empty.size_bytes, empty.fits_broadcast) == (0, 0, True)


def test_cohort_keeps_all_rows_of_its_employees(spark):
    t = tables(
        spark,
        onb=[("a", "S1", "Delayed", day(0), None), ("a", "S2", "Delayed", day(40), None),
             ("b", "S2", "Delayed", day(0), None), ("b", "S1", "Delayed", day(3), None)],
        tool=[("a", "T", moment(1), "Failed"), ("b", "T", moment(1), "Failed"), ("c", "T", moment(1), "Failed")],
        sup=[("1", "b", "C", moment(2), "Closed", 1.0), ("2", "a", "C", moment(2), "Closed", 1.0)],
    )
    cohort = prepare(t).cohort("S2").tables  # a's S2 row lies outside the first month
    assert by(cohort.onboarding, "onboarding_stage").keys() == {"S1", "S2"}
    for _, df in cohort.items():
        assert {r.employee_id for r in df.collect()} == {"b"}


def test_window_invariant_on_the_event_tables(spark):
    last_day = {"onboarding": 29, "tool_usage": 30, "support_requests": 30}  # stages start within 30 dates
    for name, df in prepare(map_events(read_events(spark, SF))).tables.items():
        low, high, nulls = df.agg(
            F.min("days_since_joining"), F.max("days_since_joining"), F.count_if(F.col("employee_id").isNull())
        ).first()
        assert (low, high, nulls) == (0, last_day[name], 0)


def test_event_date_columns_exist():
    for table, column in schemas.EVENT_DATE.items():
        assert column in schemas.SCHEMAS[table].names


