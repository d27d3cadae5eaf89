"""The layout by employee: the same first month, and no shuffle for it."""

from __future__ import annotations

import re

import pytest
from helpers import day, moment, skewed, tables
from pyspark.sql import functions as F

import storage_queries
from firstmonth import schemas
from firstmonth.operators import by_employee
from firstmonth.plans.first_month import prepare
from firstmonth.sources.event_mapping import map_events, read_events

SF = "/root/testdata/sf0.001"


def lines(df):
    return sorted(map(str, df.collect()))


def same(tables, expected):
    for (name, df), (_, other) in zip(tables.items(), expected.items()):
        assert df.dtypes == other.dtypes, name
        assert lines(df) == lines(other), name


@pytest.mark.parametrize("broadcast_bytes", [by_employee.BROADCAST_BYTES, 0])
def test_same_first_month_with_heavy_employees(spark, broadcast_bytes):
    raw = skewed(spark, SF)
    database = storage_queries.new_database(spark)
    assert by_employee.store(raw, database, rows_per_bucket=500, heavy_rows=300) > 1
    heavy = spark.table(f"{database}.{by_employee.DAYS}_spread")
    assert "EMP-HOT" in {row.employee_id for row in heavy.collect()}
    for name, df in raw.items():
        assert lines(by_employee.stored_rows(spark, database, name)) == lines(df)
        assert spark.table(f"{database}.{name}_buckets").filter("employee_id = 'EMP-HOT' or employee_id is null").isEmpty()
    same(by_employee.first_month(spark, database, broadcast_bytes=broadcast_bytes), prepare(raw).tables)


def test_keys_are_ignored_alike(spark):
    raw = map_events(read_events(spark, SF), surrogate_keys=True)
    raw = type(raw)(raw.onboarding, raw.tool_usage.unionByName(raw.tool_usage.withColumn("usage_id", -raw.tool_usage["usage_id"])), raw.support_requests)
    database = storage_queries.new_database(spark)
    by_employee.store(raw, database, rows_per_bucket=500)
    same(by_employee.first_month(spark, database, ignore_keys=True), prepare(raw, ignore_keys=True).tables)


def test_missing_values_and_empty_tables(spark):
    rows = tables(
        spark,
        onb=[("a", "S", "Delayed", day(0), None), (None, "S", "Delayed", day(0), None), ("b", "S", None, None, None)],
        tool=[("a", "T", moment(30, 23), "Failed"), ("a", "T", None, "Failed"), (None, None, None, None), ("c", "T", moment(-9), None)],
    )
    database = storage_queries.new_database(spark)
    assert by_employee.store(rows, database) == 1
    same(by_employee.first_month(spark, database), prepare(rows).tables)
    empty, nothing = storage_queries.new_database(spark), tables(spark)
    by_employee.store(nothing, empty)
    same(by_employee.first_month(spark, empty), prepare(nothing).tables)


def test_a_task_gets_a_bounded_number_of_rows(spark):
    wide, hot = spark.range(2_100_000), spark.range(150_000)
    rows = wide.selectExpr("id % 30011 as e", "id").union(hot.selectExpr("-1 as e", "id")).selectExpr(
        "concat('EMP-', e) as employee_id", "concat('T', id % 3) as tool_name", "timestamp_ntz'2026-01-05' + make_dt_interval(cast(id % 40 as int)) as usage_date",
        "'Use' as usage_activity", "'Failed' as usage_status")
    nothing = tables(spark)
    raw = type(nothing)(nothing.onboarding, rows, nothing.support_requests)
    database = storage_queries.new_database(spark)
    assert by_employee.store(raw, database) == 3
    bucketed = spark.table(f"{database}.{schemas.TOOL_USAGE}_buckets").groupBy(F.input_file_name().alias("file")).count()
    sizes = [row["count"] for row in bucketed.collect()]
    assert sum(sizes) == 2_100_000 and max(sizes) < 1_000_000
    beside = spark.table(f"{database}.{schemas.TOOL_USAGE}_spread")
    assert [tuple(row) for row in beside.groupBy("employee_id").count().collect()] == [("EMP--1", 150_000)]

    def digest(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()

    assert digest(by_employee.first_month(spark, database).tool_usage) == digest(prepare(raw).tables.tool_usage)


def test_a_layout_is_not_written_over(spark):
    database = storage_queries.new_database(spark)
    by_employee.store(tables(spark), database)
    with pytest.raises(Exception, match="already exists"):
        by_employee.store(tables(spark), database)


@pytest.mark.parametrize("broadcast_bytes, join", [(0, "SortMergeJoin"), (by_employee.BROADCAST_BYTES, "BroadcastHashJoin")])
def test_buckets_are_neither_joined_nor_deduplicated_through_a_shuffle(spark, capsys, broadcast_bytes, join):
    database = storage_queries.new_database(spark)
    by_employee.store(map_events(read_events(spark, SF)), database, rows_per_bucket=500)
    for name, df in by_employee.first_month(spark, database, broadcast_bytes=broadcast_bytes).items():
        df.explain("formatted")
        text = capsys.readouterr().out
        assert join in text
        assert re.search(r"Bucketed: true", text), name
        assert len(re.findall(r"Arguments: hashpartitioning", text)) == 1, name  # copies of heavy employees
        pushed = re.findall(r"PushedFilters: (.*)", text)
        assert any(f"GreaterThanOrEqual({schemas.EVENT_DATE[name]}," in line for line in pushed), name
