"""Onboarding stages: completion, delay and duration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstmonth.functions.predicates import first_by
from firstmonth.functions.rounding import round_exact, round_scaled
from firstmonth.operators.merged import ROWS, stage_rows


def stage_summary(onboarding: DataFrame) -> DataFrame:
    """Counts, average duration and rates per stage."""
    return (
        _per_stage(onboarding)
        .filter(F.col("onboarding_stage").isNotNull())
        .withColumn("delay_rate_pct", round_scaled(F.col("delayed_count") / F.col("total_assigned") * 100, 2))
        .withColumn(
            "completion_rate_pct", round_scaled(F.col("completed_count") / F.col("total_assigned") * 100, 2)
        )
        .orderBy(F.desc("delayed_count"), F.desc("avg_duration_days"), "onboarding_stage")
    )


def stage_status_long(summary: DataFrame) -> DataFrame:
    """The three status counts of the stage summary, one line per stage and status."""
    return summary.unpivot(
        ["onboarding_stage"], ["completed_count", "delayed_count", "in_progress_count"], "status_type", "count"
    )


def stage_list(onboarding: DataFrame) -> DataFrame:
    """The stages a cohort can be chosen by."""
    stages = onboarding.select("onboarding_stage").filter(F.col("onboarding_stage").isNotNull())
    return stages.distinct().orderBy("onboarding_stage")


def onboarding_kpis(onboarding: DataFrame) -> DataFrame:
    """One row: employees, completion rate, most delayed and longest stage, onboarding time."""
    stage, total, completed = F.col("onboarding_stage"), F.sum("total_assigned"), F.sum("completed_count")
    # Stage averages have two digits, so their sum is exact in hundredths of a day.
    hundredths = F.sum(
        F.when(stage.isNotNull(), F.rint(F.col("avg_duration_days") * 100)).cast("bigint")
    )
    employees = onboarding.select("employee_id").distinct().agg(F.count("employee_id"))
    return (
        _per_stage(onboarding)
        .agg(
            F.try_divide(completed, total).alias("rate"),
            first_by(stage, F.col("delayed_count"), F.col("avg_duration_days")).alias("delayed"),
            first_by(stage, F.col("avg_duration_days")).alias("longest"),
            (hundredths / 100).alias("days"),
        )
        .withColumn("percent", F.col("rate") * 100)
        .select(
            employees.scalar().alias("total_employees"),
            F.coalesce(round_exact(F.col("percent"), 2), F.lit(0.0)).alias("overall_completion_rate"),
            F.coalesce("delayed", F.lit("None")).alias("top_delayed_stage"),
            F.coalesce("longest", F.lit("None")).alias("top_longest_stage"),
            F.coalesce(round_scaled(F.col("days"), 1), F.lit(0.0)).alias("avg_onboarding_time_days"),
        )
    )


def _per_stage(onboarding: DataFrame) -> DataFrame:
    mean_days = F.try_divide(F.sum("days"), F.sum("ended"))
    return stage_rows(onboarding).groupBy("onboarding_stage").agg(
        F.sum(ROWS).alias("total_assigned"),
        F.sum("completed").alias("completed_count"),
        F.sum("delayed").alias("delayed_count"),
        F.sum("in_progress").alias("in_progress_count"),
        F.coalesce(round_scaled(mean_days, 2), F.lit(0.0)).alias("avg_duration_days"),
    )
