"""The first month: each table cut to Day 0 - Day 30 of its employee, deduplicated and normalised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.functions.predicates import hours_or_zero
from firstmonth.operators.day_zero import DayZero
from firstmonth.operators.quality import deduplicate
from firstmonth.sources.tables import Tables, conform


def clean_tables(tables: Tables, day_zero: DayZero, ignore_keys: bool = False) -> Tables:
    """All three tables. With ``ignore_keys`` rows that differ in their surrogate key only are copies."""
    return Tables(
        clean_onboarding(tables.onboarding, day_zero, ignore_keys),
        clean_tool_usage(tables.tool_usage, day_zero, ignore_keys),
        clean_support_requests(tables.support_requests, day_zero, ignore_keys),
    )


def clean_onboarding(onboarding: DataFrame, day_zero: DayZero, ignore_keys: bool = False) -> DataFrame:
    """Adds joining_date, days_since_joining and duration_days (null until completed, negative if dirty)."""
    return normalised(first_month(onboarding, schemas.ONBOARDING, day_zero, ignore_keys), schemas.ONBOARDING)


def clean_tool_usage(tool_usage: DataFrame, day_zero: DayZero, ignore_keys: bool = False) -> DataFrame:
    """Adds joining_date and days_since_joining."""
    return first_month(tool_usage, schemas.TOOL_USAGE, day_zero, ignore_keys)


def clean_support_requests(
    support_requests: DataFrame, day_zero: DayZero, ignore_keys: bool = False
) -> DataFrame:
    """Adds joining_date and days_since_joining; resolution_time is 0 where missing, NaN or negative."""
    rows = first_month(support_requests, schemas.SUPPORT_REQUESTS, day_zero, ignore_keys)
    return normalised(rows, schemas.SUPPORT_REQUESTS)


def normalised(rows: DataFrame, table: str) -> DataFrame:
    """The derived and repaired columns of a table, once its rows are distinct."""
    if table == schemas.ONBOARDING:
        return rows.withColumn("duration_days", F.date_diff("completion_date", "start_date"))
    if table == schemas.SUPPORT_REQUESTS:
        return rows.withColumn("resolution_time", hours_or_zero(F.col("resolution_time")))
    return rows


def first_month(df: DataFrame, table: str, day_zero: DayZero, ignore_keys: bool = False) -> DataFrame:
    """Distinct rows of Day 0 to Day 30, with joining_date and days_since_joining.

    Copies share employee and date, so cutting first and deduplicating the much smaller rest gives the
    same rows as the other order. Values are normalised after it, because different dirty values
    would otherwise become copies.
    """
    df = conform(df, table)
    return distinct_month(day_zero.attach(df, schemas.EVENT_DATE[table]), df.columns, table, ignore_keys)


def distinct_month(parts: list[DataFrame], columns: list[str], table: str, ignore_keys: bool) -> DataFrame:
    """The same of rows that have their ``joining_date``, in parts without an employee in common."""
    ignored = [schemas.SURROGATE_KEYS[table]] if ignore_keys and table in schemas.SURROGATE_KEYS else []
    date_column = schemas.EVENT_DATE[table]
    days = F.date_diff(F.to_date(date_column), "joining_date")
    in_month = days.between(0, schemas.WINDOW_DAYS)
    distinct = [deduplicate(part.filter(in_month), ignored) for part in parts]
    rows = reduce(DataFrame.unionByName, distinct)
    return rows.select(*columns, "joining_date", days.alias("days_since_joining"))
