"""The cleaned tables merged to one row a group, employee and day: all that the reports read.

The reports take either kind of table. Of a cleaned table every row counts once; of a merged one ``merged_rows``, a
reserved name, says how many rows became one. Sums of counts, of whole days and of hours in exact parts are the same
either way. The group of a row is its stage, tool or category; a missing one is a group of its own, which some
reports count and others leave out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.functions.predicates import differs
from firstmonth.functions.sums import merged_parts, row_parts
from firstmonth.sources.tables import Tables

ROWS = "merged_rows"
#: Group of each table.
GROUPS = {
    schemas.ONBOARDING: "onboarding_stage",
    schemas.TOOL_USAGE: "tool_name",
    schemas.SUPPORT_REQUESTS: "request_category",
}


def is_merged(df: DataFrame) -> bool:
    return ROWS in df.columns


def stage_rows(onboarding: DataFrame) -> DataFrame:
    """With ``completed``, ``delayed``, ``in_progress``, and days and number of durations, of all and of delayed rows."""
    status, days = F.col("stage_status"), F.col("duration_days").cast("bigint")
    delayed_days = F.when(status == "Delayed", days)
    return _counted(
        onboarding,
        completed=_one(status == "Completed"),
        delayed=_one(status == "Delayed"),
        in_progress=_one(status == "In Progress"),
        days=days,
        ended=_one(days.isNotNull()),
        delayed_days=delayed_days,
        delayed_ended=_one(delayed_days.isNotNull()),
    )


def tool_rows(tool_usage: DataFrame) -> DataFrame:
    """With ``failed``. A missing status is a failure."""
    return _counted(tool_usage, failed=_one(differs(F.col("usage_status"), "Success")))


def request_rows(support_requests: DataFrame) -> DataFrame:
    """With ``unresolved``, ``hours`` (exact parts) and ``timed``, the number of rows with hours."""
    hours = F.col("resolution_time")
    return _counted(
        support_requests,
        unresolved=_one(differs(F.col("request_status"), "Resolved")),
        hours=row_parts(hours),
        timed=_one(hours.isNotNull()),
    )


def merge(tables: Tables) -> Tables:
    """The three cleaned tables, merged; copies of a key meet before the only shuffle of each."""
    counted = Tables(stage_rows(tables.onboarding), tool_rows(tables.tool_usage), request_rows(tables.support_requests))
    measures = {
        schemas.ONBOARDING: [
            _total(c) for c in ("completed", "delayed", "in_progress", "days", "ended", "delayed_days", "delayed_ended")
        ],
        schemas.TOOL_USAGE: [_total("failed")],
        schemas.SUPPORT_REQUESTS: [_total("unresolved"), merged_parts(F.col("hours")).alias("hours"), _total("timed")],
    }
    merged = [
        df.groupBy(GROUPS[name], "employee_id", "days_since_joining").agg(_total(ROWS), *measures[name])
        for name, df in counted.items()
    ]
    return Tables(*merged)


def _counted(df: DataFrame, **measures: Column) -> DataFrame:
    return df if is_merged(df) else df.withColumns({**measures, ROWS: F.lit(1)})


def _one(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _total(name: str) -> Column:
    return F.sum(name).alias(name)
