from __future__ import annotations

from helpers import by, day, moment, only, tables
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.operators import quality
from firstmonth.sources.tables import Tables


def dirty(spark):
    return tables(
        spark,
        onb=[("a", "S", "Completed", day(3), day(1))] * 2
        + [(None, "S", "Completed", day(0), None)] * 3
        + [("b", "S", "Unknown", day(0), day(0))],
        tool=[("a", "T", moment(0), "Success"), ("a", "T", moment(0), None)],
        sup=[("1", "a", "C", moment(0), "Resolved", -2.0)] * 2
        + [("1", "b", "C", moment(0), "Resolved", None), (None, "c", "C", moment(0), "Lost", 1.0)],
    )


def test_audit(spark):
    # Missing employees are counted with their copies, inverted dates and negative times without.
    assert only(quality.audit(dirty(spark))) == {
        "missing_employee_ids": 3,
        "duplicate_records": 1 + 2 + 1,
        "invalid_timestamps": 1,
        "negative_resolution_times": 1,
    }
    assert {tuple(r) for r in quality.audit_warnings(dirty(spark)).collect()} == {
        ("onboarding", "Found 3 missing employee_ids in table 'onboarding'."),
        ("onboarding", "Deduplicated 3 duplicate records from 'onboarding'."),
        ("support_requests", "Deduplicated 1 duplicate records from 'support_requests'."),
    }


def test_audit_reads_text_that_does_not_parse_as_missing(spark):
    t = dirty(spark)
    onb = spark.createDataFrame(
        [("a", "S", "2026-01-09", "2026-01-05"), ("b", "S", "soon", "2026-01-05"), ("c", "S", "2026-01-05", None)],
        "employee_id string, onboarding_stage string, start_date string, completion_date string",
    )
    sup = t.support_requests.withColumn("resolution_time", F.lit("-3")).limit(1)
    got = only(quality.audit(Tables(onb, t.tool_usage, sup)))
    assert (got["invalid_timestamps"], got["negative_resolution_times"]) == (1, 1)


def test_audit_without_optional_columns(spark):
    t = dirty(spark)
    bare = Tables(t.onboarding.drop("completion_date"), t.tool_usage, t.support_requests.drop("resolution_time"))
    got = only(quality.audit(bare))
    assert (got["invalid_timestamps"], got["negative_resolution_times"]) == (0, 0)


def test_audit_of_clean_and_of_empty_tables(spark):
    assert set(only(quality.audit(tables(spark))).values()) == {0}
    assert quality.audit_warnings(tables(spark)).count() == 0


def test_deduplicate_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, None), (None, None), (1, 2)], "a int, b int")
    assert quality.deduplicate(df).count() == 3


def test_constraint_violations(spark):
    got = {(r.table_name, r.rule): r.violations for r in quality.constraint_violations(dirty(spark)).collect()}
    broken = {key: n for key, n in got.items() if n}
    assert broken == {
        ("onboarding", "employee_id_not_null"): 3,
        ("onboarding", "stage_status_domain"): 1,
        ("onboarding", "completion_not_before_start"): 2,
        ("support_requests", "request_id_not_null"): 1,
        ("support_requests", "request_id_unique"): 2,
        ("support_requests", "request_status_domain"): 1,
        ("support_requests", "resolution_time_not_negative"): 2,
    }
    assert ("tool_usage", "usage_status_domain") in got  # a missing status breaks no rule


def test_lengths_and_surrogate_keys(spark):
    t = dirty(spark)
    tool = t.tool_usage.withColumn("tool_name", F.repeat(F.lit("x"), 101)).withColumn("usage_id", F.lit(7))
    got = by(quality.constraint_violations(Tables(t.onboarding, tool, t.support_requests)).filter(
        "table_name = 'tool_usage'"), "rule")
    assert got["tool_name_max_length"]["violations"] == 2
    assert got["usage_id_unique"]["violations"] == 1


def test_split_violations_keeps_every_row(spark):
    for name, df in dirty(spark).items():
        good, bad = quality.split_violations(df, name)
        assert good.count() + bad.count() == df.count()
        assert good.columns == df.columns
    good, bad = quality.split_violations(dirty(spark).support_requests, schemas.SUPPORT_REQUESTS)
    assert good.count() == 1
    rules = sorted(tuple(sorted(r.broken_rules)) for r in bad.collect())
    assert rules == [
        ("request_id_not_null", "request_status_domain"),
        ("resolution_time_not_negative",),
        ("resolution_time_not_negative",),
    ]


def test_audit_counts_what_cleaning_drops_when_keys_are_ignored(spark):
    t = dirty(spark)
    rows = t.tool_usage.withColumn("usage_id", F.monotonically_increasing_id())
    keyed = Tables(t.onboarding, rows.unionByName(rows.withColumn("usage_id", F.col("usage_id") + 1_000)), t.support_requests)
    strict, loose = (by(quality.audit_by_table(keyed, flag), "table_name")["tool_usage"] for flag in (False, True))
    assert strict["duplicate_records"] == 0
    left = quality.deduplicate(keyed.tool_usage, ["usage_id"]).count()
    assert loose["duplicate_records"] == keyed.tool_usage.count() - left > 0
