"""The one-row executive summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstmonth.operators.onboarding import onboarding_kpis
from firstmonth.operators.support import support_kpis
from firstmonth.operators.tools import tool_leaders
from firstmonth.sources.tables import Tables


def overview_kpis(tables: Tables) -> DataFrame:
    """Headline numbers of all three sources; 'N/A' where a source has no rows at all."""
    onboarding = onboarding_kpis(tables.onboarding).select(
        F.col("total_employees").alias("total_hires"),
        F.col("overall_completion_rate").alias("completion_rate"),
        F.col("avg_onboarding_time_days").alias("avg_completion_days"),
        F.when(F.col("total_employees") > 0, F.col("top_delayed_stage")).alias("top_delayed_stage"),
    )
    support = support_kpis(tables.support_requests).select(
        F.col("total_requests").alias("total_support_requests"),
        F.when(F.col("total_requests") > 0, F.col("most_common_category")).alias("most_common_issue"),
    )
    tools = tool_leaders(tables.tool_usage).select(
        F.when(
            F.col("total_events") > 0, F.coalesce("most_problematic_tool", F.lit("None"))
        ).alias("most_problematic_tool")
    )
    # Three one-row frames with different columns become one row.
    rows = onboarding.unionByName(support, True).unionByName(tools, True)

    def only(name: str):
        return F.max(name).alias(name)

    def text(name: str):
        return F.coalesce(F.max(name), F.lit("N/A")).alias(name)

    return rows.agg(
        only("total_hires"),
        only("completion_rate"),
        only("avg_completion_days"),
        only("total_support_requests"),
        text("most_common_issue"),
        text("top_delayed_stage"),
        text("most_problematic_tool"),
    )
