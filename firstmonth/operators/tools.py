"""Internal tools: usage, failures and the overlap with support requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstmonth.functions.predicates import first_by
from firstmonth.functions.rounding import round_scaled
from firstmonth.operators.merged import ROWS, tool_rows


def per_tool_and_employee(tool_usage: DataFrame) -> DataFrame:
    """Events and failures per tool and employee. A missing status is a failure.

    The two-column key spreads evenly, and a very active employee is merged before the shuffle.
    """
    return (
        tool_rows(tool_usage)
        .filter(F.col("tool_name").isNotNull())
        .groupBy("tool_name", "employee_id")
        .agg(F.sum(ROWS).alias("events"), F.sum("failed").alias("failed"))
    )


def tool_summary(tool_usage: DataFrame) -> DataFrame:
    """Events, users and failure rate per tool."""
    events, failed = F.sum("events"), F.sum("failed")
    return (
        per_tool_and_employee(tool_usage)
        .groupBy("tool_name")
        .agg(
            events.alias("total_usage_events"),
            F.count("employee_id").alias("active_users"),
            (events - failed).alias("successful_events"),
            failed.alias("failed_events"),
        )
        .withColumn(
            "failure_rate_pct", round_scaled(F.col("failed_events") / F.col("total_usage_events") * 100, 2)
        )
        .orderBy(F.desc("total_usage_events"), "tool_name")
    )


def tool_kpis(tool_usage: DataFrame) -> DataFrame:
    """One row: the most and least used tool, and the one with the most failures."""
    names = ["most_used_tool", "least_used_tool", "most_problematic_tool"]
    return tool_leaders(tool_usage).select(*[F.coalesce(name, F.lit("None")).alias(name) for name in names])


def tool_leaders(tool_usage: DataFrame) -> DataFrame:
    """One row: all events, and the leading tools, null where there are none."""
    tool, events, failed = F.col("tool_name"), F.col("events"), F.col("failed")
    per_tool = (
        tool_rows(tool_usage).groupBy("tool_name").agg(F.sum(ROWS).alias("events"), F.sum("failed").alias("failed"))
    )
    # The least used tool is the last of the descending list: the lowest count, then the highest name.
    least_used = F.max_by(tool, F.when(tool.isNotNull(), F.struct(-events, tool)))
    return per_tool.agg(
        F.coalesce(F.sum(events), F.lit(0)).alias("total_events"),
        first_by(tool, events).alias("most_used_tool"),
        least_used.alias("least_used_tool"),
        first_by(tool, failed).alias("most_problematic_tool"),
    )


def tool_support_overlap(tool_usage: DataFrame, support_requests: DataFrame) -> DataFrame:
    """Tool events and failures of employees who asked for support.

    Both sides are merged per employee first, so the join sees at most one row per tool and employee. It
    is an inner join with distinct employees, because a left semi join would be moved below the merge,
    where all rows of a hot employee meet in one task.
    """
    supported = support_requests.select("employee_id").distinct()
    return (
        per_tool_and_employee(tool_usage)
        .join(supported, "employee_id")
        .groupBy("tool_name")
        .agg(
            F.sum("events").alias("events_by_supported_employees"),
            F.sum("failed").alias("failed_events"),
        )
        .orderBy(F.desc("failed_events"), "tool_name")
    )
