"""One full run: audit, cleaning, optional cohort, and the data of all six dashboard pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from firstmonth.operators import friction, journey, onboarding, overview, quality, support, tools
from firstmonth.operators.cohort import stage_cohort
from firstmonth.operators.merged import merge
from firstmonth.plans.first_month import prepare
from firstmonth.sources import saved
from firstmonth.sources.tables import Tables

@dataclass(frozen=True)
class Dashboard:
    """The audit, the stages to choose a cohort from, and the frames of each page."""

    audit: DataFrame
    audit_warnings: DataFrame
    stage_list: DataFrame
    pages: dict[str, dict[str, DataFrame]]

    def frames(self) -> dict[str, DataFrame]:
        """All frames by name; those of a page begin with the page's."""
        audits = {"audit": self.audit, "audit_warnings": self.audit_warnings, "stage_list": self.stage_list}
        return audits | {f"{page}_{name}": df for page, frames in self.pages.items() for name, df in frames.items()}


def build_dashboard(raw: Tables, stage: str | None = None, ignore_keys: bool = False) -> Dashboard | None:
    """All frames for all employees or for the cohort of one stage; None when there are no rows at all.

    Each cleaned table is computed once, merged to one row a group, employee and day, and written; every frame derives from
    these rows, those of a cohort too. The audit counts are kept for the same reason.
    """
    if not raw.has_rows():
        return None
    everyone = save_merged(prepare(raw, ignore_keys).tables)
    audit_counts = quality.audit_by_table(raw, ignore_keys).checkpoint()
    return Dashboard(
        audit=quality.audit_totals(audit_counts),
        audit_warnings=quality.warning_lines(audit_counts),
        stage_list=onboarding.stage_list(everyone.onboarding),
        pages=build_pages(merged_cohort(everyone, stage) if stage else everyone),
    )


def save_merged(cleaned: Tables) -> Tables:
    """The cleaned tables, merged, as Parquet in the shared folder."""
    return Tables(*(saved.save(df, f"merged-{name}")[0] for name, df in merge(cleaned).items()))


def merged_cohort(everyone: Tables, stage: str) -> Tables:
    """The merged rows of the employees seen at ``stage``, whose list is sent to the rows if its measured size allows."""
    employees, size = saved.save(
        stage_cohort(everyone.onboarding, stage), "cohort", held=saved.held_bytes("employee_id")
    )
    cohort = saved.small(employees, size["held"])
    return Tables(*(df.join(cohort, "employee_id", "left_semi") for _, df in everyone.items()))


def build_pages(tables: Tables) -> dict[str, dict[str, DataFrame]]:
    points = friction.friction_points(tables).checkpoint()  # a row for each stage, tool and category
    stages = onboarding.stage_summary(tables.onboarding)
    return {
        "overview": {
            "kpis": overview.overview_kpis(tables),
            "primary_bottleneck": friction.primary_bottleneck(points),
        },
        "onboarding": {
            "kpis": onboarding.onboarding_kpis(tables.onboarding),
            "stage_summary": stages,
            "stage_status": onboarding.stage_status_long(stages),
        },
        "tools": {
            "kpis": tools.tool_kpis(tables.tool_usage),
            "tool_summary": tools.tool_summary(tables.tool_usage),
            "support_overlap": tools.tool_support_overlap(tables.tool_usage, tables.support_requests),
        },
        "support": {
            "kpis": support.support_kpis(tables.support_requests),
            "category_summary": support.support_category_summary(tables.support_requests),
            "timeline": support.support_timeline(tables.support_requests),
            "repeated_issues": support.repeated_issues(tables.support_requests),
        },
        "friction": {
            "points": points,
            "evidence": friction.friction_evidence(points),
            "ranked": friction.friction_ranked(points),
        },
        "journey": {
            "daily": journey.journey_daily(tables),
            "weekly_tickets": journey.journey_weekly_tickets(tables.support_requests),
        },
    }
