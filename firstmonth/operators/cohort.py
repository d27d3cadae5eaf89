"""The employees seen at one onboarding stage; ``DayZero.restricted_to`` cuts all tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_cohort(onboarding: DataFrame, stage: str) -> DataFrame:
    """Employees with at least one first-month row at the stage."""
    return onboarding.filter(F.col("onboarding_stage") == stage).select("employee_id").distinct()
