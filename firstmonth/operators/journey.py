"""Event density over the first month, by day and by week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.operators.merged import ROWS, is_merged
from firstmonth.sources.tables import Tables

# The four weeks (first day, last day).
WEEKS = [(0, 7), (8, 14), (15, 21), (22, 30)]
# Count column per table.
DAILY_COLUMNS = {
    schemas.ONBOARDING: "onboarding_events",
    schemas.TOOL_USAGE: "tool_events",
    schemas.SUPPORT_REQUESTS: "support_tickets",
}


def journey_daily(tables: Tables) -> DataFrame:
    """31 days with the events of each source, 0 where there are none.

    The days without events come from a spine that is added to the counts, not joined to them; all
    rows are merged per day before the one small shuffle.
    """
    counts = list(DAILY_COLUMNS.values())
    rows = _days(tables.onboarding.sparkSession).select("days_since_joining", *[F.lit(0).alias(c) for c in counts])
    for name, df in tables.items():
        own = [(_events(df) if c == DAILY_COLUMNS[name] else F.lit(0)).alias(c) for c in counts]
        rows = rows.unionByName(df.select("days_since_joining", *own))
    return rows.groupBy("days_since_joining").agg(*[F.sum(c).alias(c) for c in counts])


def journey_weekly_tickets(support_requests: DataFrame) -> DataFrame:
    """Support requests in each of the four weeks, 0 where there are none."""
    day = F.col("days_since_joining")
    week = F.coalesce(*[F.when(day.between(*bounds), i) for i, bounds in enumerate(WEEKS, 1)])
    spine = _days(support_requests.sparkSession).select(week.alias("week"), F.lit(0).alias("tickets"))
    tickets = support_requests.select(week.alias("week"), _events(support_requests).alias("tickets"))
    first, last = (
        F.element_at(F.array(*[F.lit(bounds[i]) for bounds in WEEKS]), F.col("week")) for i in (0, 1)
    )
    return (
        spine.unionByName(tickets)
        .groupBy("week")
        .agg(F.sum("tickets").alias("support_tickets"))
        .select("week", first.alias("day_from"), last.alias("day_to"), "support_tickets")
    )


def _events(df: DataFrame) -> Column:
    """How many events a row stands for."""
    return F.col(ROWS) if is_merged(df) else F.lit(1)


def _days(spark: SparkSession) -> DataFrame:
    days = spark.range(schemas.WINDOW_DAYS + 1)
    return days.select(F.col("id").cast("int").alias("days_since_joining"))
