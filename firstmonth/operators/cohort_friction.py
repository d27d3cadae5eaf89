"""The friction points of the cohorts of all stages in one run.

A cohort is everyone seen at a stage, and an employee belongs to as many cohorts as stages. Each source is merged once
per group and employee, whatever the number of cohorts; only then does an employee's merged row count for each of their
stages, which a set of bits names. The tables are read as often as for one cohort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstmonth.operators import friction
from firstmonth.sources.tables import Tables

#: Stages of a choice list; their names are constants of the plan.
MAX_STAGES = 1_000
_WORD = 63


def cohort_friction(tables: Tables) -> DataFrame:
    """``onboarding_stage`` and the friction points of its cohort, by stage and falling score."""
    found = tables.onboarding.filter(F.col("onboarding_stage").isNotNull()).select("onboarding_stage").distinct()
    stages = sorted(row[0] for row in found.limit(MAX_STAGES + 1).collect())
    if len(stages) > MAX_STAGES:
        raise ValueError(f"More than {MAX_STAGES} stages; choose one cohort at a time.")
    members = stage_sets(tables.onboarding, stages)
    cohorts = _cohorts(stages)
    sizes = members.select(F.explode(cohorts).alias("size_stage")).groupBy("size_stage").agg(F.count(F.lit(1)).alias("size"))

    def by_cohort(per_employee: DataFrame) -> DataFrame:
        """One row an employee and group on either side of the join; after it one for each of the employee's stages."""
        return per_employee.join(members, "employee_id").select("*", F.explode(cohorts).alias("onboarding_stage"))

    key = "onboarding_stage"
    groups = friction.tagged_groups(
        friction.delayed_stages(by_cohort(friction.delayed_per_employee(tables.onboarding)), key),
        friction.failing_tools(by_cohort(friction.failing_per_employee(tables.tool_usage)), key),
        friction.support_categories(by_cohort(friction.requests_per_employee(tables.support_requests)), key),
    )
    sized = groups.join(F.broadcast(sizes), F.col(key) == F.col("size_stage"))  # MAX_STAGES rows
    return friction.scored(sized, F.col("size"), key).orderBy(key, *friction.ranking())


def stage_sets(onboarding: DataFrame, stages: list[str]) -> DataFrame:
    """``employee_id`` and the employee's stages as bits of ``word0``, ``word1``, ...; merged before the shuffle."""
    at = {stage: divmod(i, _WORD) for i, stage in enumerate(stages)}
    bits = [
        F.bit_or(F.coalesce(*[F.when(F.col("onboarding_stage") == s, F.lit(1 << b)) for s, (w, b) in at.items() if w == word], F.lit(0)).cast("bigint"))
        for word in range(-(-len(stages) // _WORD))
    ]
    known = onboarding.filter(F.col("onboarding_stage").isNotNull())
    if not bits:
        return known.select("employee_id", F.lit(0).cast("bigint").alias("word0"))
    return known.groupBy("employee_id").agg(*[b.alias(f"word{w}") for w, b in enumerate(bits)])


def _cohorts(stages: list[str]) -> Column:
    """The stages that the bits of a row name."""
    named = [
        F.when(F.col(f"word{i // _WORD}").bitwiseAND(F.lit(1 << i % _WORD)) != 0, F.lit(stage)) for i, stage in enumerate(stages)
    ]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")
