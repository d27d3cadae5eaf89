"""The ranked list of friction points over all three sources."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstmonth.functions.rounding import one_decimal, round_exact
from firstmonth.functions.sums import merged_parts, parts_total
from firstmonth.operators.merged import ROWS, is_merged, request_rows, stage_rows
from firstmonth.operators.tools import per_tool_and_employee
from firstmonth.sources.tables import Tables


@dataclass(frozen=True)
class Source:
    """What one source contributes to the ranking."""

    source: str
    label: str
    metric_divisor: float
    weight: float
    metric_text: str
    evidence: str
    impact: str


# Labels, scoring constants and wording. {n} is the frequency, {pct} the affected share,
# {m} the metric of the source.
STAGE_DELAY = Source(
    source="Onboarding Progress",
    label="Onboarding Stage Delay: ",
    metric_divisor=5.0,
    weight=10.0,
    metric_text="{m} days average completion time",
    evidence="{n} delayed stage assignments affecting {pct}% of new hires.",
    impact="Slows down progression to subsequent onboarding milestones and initial team contribution.",
)
TOOL_FAILURE = Source(
    source="Internal Tool Usage",
    label="Tool Usage Failure: ",
    metric_divisor=20.0,
    weight=8.0,
    metric_text="{m}% usage error rate",
    evidence="{n} failed/timeout access events across {pct}% of new hires.",
    impact="Blocks daily operational workflows and creates login/authentication downtime.",
)
SUPPORT = Source(
    source="Support Requests",
    label="Support Dependency: ",
    metric_divisor=12.0,
    weight=9.0,
    metric_text="{m} hours MTTR resolution time",
    evidence="{n} helpdesk requests logged with average resolution time of {m} hrs.",
    impact="Indicates IT access barriers that halt work until helpdesk tickets are resolved.",
)
# Metric of a group without any duration or resolution time.
DEFAULT_DELAY_DAYS = 4.0
DEFAULT_RESOLUTION_HOURS = 8.0


def friction_points(tables: Tables) -> DataFrame:
    """Delayed stages, failing tools and support categories, highest score first.

    Each source is merged per group and employee before anything is shuffled by group, which also
    gives the number of affected employees without a second pass.
    """
    everything = tagged_groups(
        delayed_stages(delayed_per_employee(tables.onboarding)),
        failing_tools(failing_per_employee(tables.tool_usage)),
        support_categories(requests_per_employee(tables.support_requests)),
    )
    return scored(everything, cohort_size(tables.onboarding).scalar()).orderBy(*ranking())


def tagged_groups(stages: DataFrame, tools: DataFrame, categories: DataFrame) -> DataFrame:
    """The groups of all three sources with what each source contributes to their lines."""
    groups = [_tagged(stages, STAGE_DELAY), _tagged(tools, TOOL_FAILURE), _tagged(categories, SUPPORT)]
    return groups[0].unionByName(groups[1]).unionByName(groups[2])


def friction_evidence(points: DataFrame) -> DataFrame:
    return points.select("friction_point", "frequency", "affected_pct", "impact_metric", "friction_score")


def friction_ranked(points: DataFrame) -> DataFrame:
    """With the rank in front. One row per stage, tool and category: a single ordered window is enough."""
    return points.select(F.row_number().over(Window.orderBy(*ranking())).alias("rank"), "*")


def primary_bottleneck(points: DataFrame) -> DataFrame:
    """The friction point with the highest score."""
    return points.orderBy(*ranking()).limit(1).select(
        "friction_point", "affected_pct", "affected_employees", "evidence", "productivity_impact"
    )


def cohort_size(onboarding: DataFrame) -> DataFrame:
    """Employees with onboarding rows, at least 1."""
    employees = onboarding.select("employee_id").distinct()
    return employees.agg(F.greatest(F.count("employee_id"), F.lit(1)))


def ranking() -> list[Column]:
    return [F.desc("friction_score"), F.asc("friction_point")]


def delayed_per_employee(onboarding: DataFrame) -> DataFrame:
    delayed = F.col("delayed") > 0 if is_merged(onboarding) else F.col("stage_status") == "Delayed"
    rows = stage_rows(onboarding.filter(delayed & F.col("onboarding_stage").isNotNull()))
    return rows.groupBy(F.col("onboarding_stage").alias("name"), "employee_id").agg(
        F.sum("delayed").alias("n"), F.sum("delayed_days").alias("days"), F.sum("delayed_ended").alias("ended")
    )


def delayed_stages(per_employee: DataFrame, *keys: str) -> DataFrame:
    mean = F.try_divide(F.sum("days"), F.sum("ended"))
    return per_employee.groupBy(*keys, "name").agg(
        F.sum("n").alias("frequency"),
        F.count("employee_id").alias("affected_employees"),
        F.coalesce(mean, F.lit(DEFAULT_DELAY_DAYS)).alias("raw_metric"),
    )


def failing_per_employee(tool_usage: DataFrame) -> DataFrame:
    return per_tool_and_employee(tool_usage).withColumnRenamed("tool_name", "name")


def failing_tools(per_employee: DataFrame, *keys: str) -> DataFrame:
    failed = F.sum("failed")
    return (
        per_employee.groupBy(*keys, "name")
        .agg(
            failed.alias("frequency"),
            F.count_if(F.col("failed") > 0).alias("affected_employees"),
            (failed / F.sum("events") * 100).alias("raw_metric"),
        )
        .filter(F.col("frequency") > 0)
    )


def requests_per_employee(support_requests: DataFrame) -> DataFrame:
    return (
        request_rows(support_requests)
        .filter(F.col("request_category").isNotNull())
        .groupBy(F.col("request_category").alias("name"), "employee_id")
        .agg(
            F.sum(ROWS).alias("n"),
            merged_parts(F.col("hours")).alias("hours"),
            F.sum("timed").alias("timed"),
        )
    )


def support_categories(per_employee: DataFrame, *keys: str) -> DataFrame:
    total = parts_total(merged_parts(F.col("hours")))
    mean = F.try_divide(total, F.sum("timed"))
    return per_employee.groupBy(*keys, "name").agg(
        F.sum("n").alias("frequency"),
        F.count("employee_id").alias("affected_employees"),
        F.coalesce(mean, F.lit(DEFAULT_RESOLUTION_HOURS)).alias("raw_metric"),
    )


def _tagged(groups: DataFrame, source: Source) -> DataFrame:
    """The groups of one source with everything the source contributes to their lines."""
    return groups.select("*", *[F.lit(getattr(source, f.name)).alias(f.name) for f in fields(source)])


def scored(groups: DataFrame, size: Column, *keys: str) -> DataFrame:
    """The lines of the ranking, ``keys`` in front; ``size`` is the number of employees that shares refer to."""
    metric, frequency, share = F.col("metric"), F.col("frequency"), F.col("share")
    score = frequency * share * (1 + metric / F.col("metric_divisor")) * F.col("weight")
    rounded = groups.select("*", (F.col("affected_employees") / size).alias("share")).select(
        "*",
        round_exact(F.col("raw_metric"), 1).alias("metric"),
        round_exact(share * 100, 1).alias("affected_pct"),
    )
    return rounded.select("*", score.alias("score")).select(
        *keys,
        F.concat("label", "name").alias("friction_point"),
        "source",
        "frequency",
        "affected_employees",
        "affected_pct",
        _fill("metric_text").alias("impact_metric"),
        round_exact(F.col("score"), 1).alias("friction_score"),
        _fill("evidence").alias("evidence"),
        F.col("impact").alias("productivity_impact"),
    )


def _fill(template: str) -> Column:
    text = F.replace(template, F.lit("{n}"), F.col("frequency").cast("string"))
    text = F.replace(text, F.lit("{pct}"), one_decimal(F.col("affected_pct")))
    return F.replace(text, F.lit("{m}"), one_decimal(F.col("metric")))
