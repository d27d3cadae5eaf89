"""Support requests: volume, resolution time, timeline and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstmonth.functions.predicates import first_by
from firstmonth.functions.rounding import round_exact, round_scaled
from firstmonth.functions.sums import merged_parts, parts_total
from firstmonth.operators.merged import ROWS, request_rows


def support_category_summary(support_requests: DataFrame) -> DataFrame:
    """Requests, unresolved requests and average resolution time per category."""
    return (
        _per_category(support_requests)
        .filter(F.col("request_category").isNotNull())
        .select("request_category", "total_requests", "unresolved_count", "avg_resolution_hours")
        .orderBy(F.desc("total_requests"), "request_category")
    )


def support_kpis(support_requests: DataFrame) -> DataFrame:
    """One row: totals, mean resolution time, the most common and the slowest category."""
    category, total = F.col("request_category"), F.sum("total_requests")
    hours = parts_total(merged_parts(F.col("hours")))
    return (
        _per_category(support_requests)
        .agg(
            total.alias("total"),
            F.sum("unresolved_count").alias("unresolved"),
            F.try_divide(hours, total).alias("mean_hours"),
            first_by(category, F.col("total_requests")).alias("common"),
            first_by(category, F.col("avg_resolution_hours")).alias("slowest"),
        )
        .select(
            F.coalesce("total", F.lit(0)).alias("total_requests"),
            F.coalesce("unresolved", F.lit(0)).alias("unresolved_requests"),
            F.coalesce(round_exact(F.col("mean_hours"), 2), F.lit(0.0)).alias("avg_resolution_hrs"),
            F.coalesce("common", F.lit("None")).alias("most_common_category"),
            F.coalesce("slowest", F.lit("None")).alias("slowest_category"),
        )
    )


def support_timeline(support_requests: DataFrame) -> DataFrame:
    """Requests per day and category."""
    return (
        request_rows(support_requests)
        .filter(F.col("request_category").isNotNull())
        .groupBy("days_since_joining", "request_category")
        .agg(F.sum(ROWS).alias("request_count"))
    )


def repeated_issues(support_requests: DataFrame) -> DataFrame:
    """One row: requests beyond the first of the same employee in the same category."""
    per_issue = (
        request_rows(support_requests)
        .filter(F.col("request_category").isNotNull())
        .groupBy("employee_id", "request_category")
        .agg(F.sum(ROWS).alias("n"))
    )
    return per_issue.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_issues_count"))


def _per_category(support_requests: DataFrame) -> DataFrame:
    merged = request_rows(support_requests).groupBy("request_category").agg(
        F.sum(ROWS).alias("total_requests"),
        F.sum("unresolved").alias("unresolved_count"),
        merged_parts(F.col("hours")).alias("hours"),
        F.sum("timed").alias("timed"),
    )
    mean_hours = F.try_divide(parts_total(F.col("hours")), F.col("timed"))
    return merged.withColumn("avg_resolution_hours", F.coalesce(round_scaled(mean_hours, 2), F.lit(0.0)))
