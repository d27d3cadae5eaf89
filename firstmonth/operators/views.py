"""The SQL side: four views with Day 0 from onboarding alone, and three reports over the raw tables.

Its rules differ from the cleaned path on purpose: Day 30 of a timestamp ends at midnight, rows are
not deduplicated, null states count as neither failed nor unresolved, null times are not zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.functions.rounding import mean_half_up, percent_half_up, round_half_up
from firstmonth.functions.sums import exact_mean
from firstmonth.operators.day_zero import DayZero, measure, onboarding_start_dates
from firstmonth.sources.tables import Tables, conform


def employee_start_dates(onboarding: DataFrame) -> DataFrame:
    """Earliest onboarding start per employee; rows without an employee form one group."""
    return onboarding.groupBy("employee_id").agg(F.min("start_date").alias("joining_date"))


def first_30_days_onboarding(onboarding: DataFrame, starts: DayZero) -> DataFrame:
    rows = _within(onboarding, schemas.ONBOARDING, starts)
    return rows.select(
        "onboarding_id",
        "employee_id",
        "joining_date",
        "onboarding_stage",
        "stage_status",
        "start_date",
        "completion_date",
        F.date_diff("start_date", "joining_date").alias("start_day_offset"),
        F.date_diff("completion_date", "start_date").alias("stage_duration_days"),
    )


def first_30_days_tool_usage(tool_usage: DataFrame, starts: DayZero) -> DataFrame:
    rows = _within(tool_usage, schemas.TOOL_USAGE, starts)
    return rows.select(
        "usage_id",
        "employee_id",
        "joining_date",
        "tool_name",
        "usage_date",
        "usage_activity",
        "usage_status",
        F.date_diff(F.to_date("usage_date"), "joining_date").alias("days_since_joining"),
    )


def first_30_days_support(support_requests: DataFrame, starts: DayZero) -> DataFrame:
    rows = _within(support_requests, schemas.SUPPORT_REQUESTS, starts)
    return rows.select(
        "request_id",
        "employee_id",
        "joining_date",
        "request_category",
        "request_date",
        "request_status",
        "resolution_time",
        F.date_diff(F.to_date("request_date"), "joining_date").alias("days_since_joining"),
    )


def register_catalog_views(spark: SparkSession, database: str) -> None:
    """Create the four views in the catalog as text over the stored tables: they follow every later change of rows and outlive the session.

    Day 0 is grouped and joined when a view is read; Spark picks the join by the sizes it sees then. In this session
    they also go by their bare names. Register again when a table has got other columns.
    """
    start_dates = f"SELECT employee_id, min(start_date) AS joining_date FROM {database}.{schemas.ONBOARDING} GROUP BY employee_id"
    _create_view(spark, database, schemas.VIEW_START_DATES, start_dates)
    tail = {
        schemas.ONBOARDING: """datediff(t.start_date, s.joining_date) AS start_day_offset,
            datediff(t.completion_date, t.start_date) AS stage_duration_days""",
        schemas.TOOL_USAGE: "datediff(CAST(t.usage_date AS DATE), s.joining_date) AS days_since_joining",
        schemas.SUPPORT_REQUESTS: "datediff(CAST(t.request_date AS DATE), s.joining_date) AS days_since_joining",
    }
    names = {
        schemas.ONBOARDING: schemas.VIEW_ONBOARDING,
        schemas.TOOL_USAGE: schemas.VIEW_TOOL_USAGE,
        schemas.SUPPORT_REQUESTS: schemas.VIEW_SUPPORT,
    }
    for table, view in names.items():
        present = spark.table(f"{database}.{table}").columns
        cells = []
        for field in schemas.SCHEMAS[table]:
            if field.name in present:
                cells.append(f"t.{field.name}")
            else:  # an imported upload has no key, and may lack optional columns
                default = schemas.OPTIONAL_DEFAULTS[table].get(field.name)
                literal = "NULL" if default is None else f"'{default}'"
                cells.append(f"CAST({literal} AS {field.dataType.simpleString()}) AS {field.name}")
        at = f"t.{schemas.EVENT_DATE[table]}"
        _create_view(
            spark,
            database,
            view,
            f"""SELECT {", ".join([*cells[:2], "s.joining_date", *cells[2:], tail[table]])}
            FROM {database}.{table} t JOIN ({start_dates}) s ON t.employee_id = s.employee_id
            WHERE {at} >= s.joining_date AND {at} <= date_add(s.joining_date, {schemas.WINDOW_DAYS})""",
        )


def _create_view(spark: SparkSession, database: str, view: str, text: str) -> None:
    spark.sql(f"CREATE OR REPLACE VIEW {database}.{view} AS {text}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} AS SELECT * FROM {database}.{view}")


def register_views(tables: Tables) -> None:
    """The same for tables that are not stored. Day 0 is taken now: register again when the tables change."""
    starts = measure(onboarding_start_dates(tables.onboarding))
    employee_start_dates(tables.onboarding).createOrReplaceTempView(schemas.VIEW_START_DATES)
    first_30_days_onboarding(tables.onboarding, starts).createOrReplaceTempView(schemas.VIEW_ONBOARDING)
    first_30_days_tool_usage(tables.tool_usage, starts).createOrReplaceTempView(schemas.VIEW_TOOL_USAGE)
    first_30_days_support(tables.support_requests, starts).createOrReplaceTempView(schemas.VIEW_SUPPORT)


def stage_delays(onboarding: DataFrame) -> DataFrame:
    days = F.date_diff("completion_date", "start_date")
    return (
        onboarding.groupBy("onboarding_stage")
        .agg(
            F.count(F.lit(1)).alias("total_assignments"),
            F.count_if(F.col("stage_status") == "Completed").alias("completed_count"),
            F.count_if(F.col("stage_status") == "Delayed").alias("delayed_count"),
            mean_half_up(F.sum(days), F.count(days)).alias("avg_duration_days"),
        )
        .orderBy(F.desc("delayed_count"), F.desc_nulls_first("avg_duration_days"), "onboarding_stage")
    )


def tool_failures(tool_usage: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("usage_status") != "Success")
    total = F.count(F.lit(1))
    return (
        tool_usage.groupBy("tool_name")
        .agg(
            total.alias("total_usage_events"),
            failed.alias("failed_usage_events"),
            percent_half_up(failed, total).alias("failure_rate_pct"),
        )
        .orderBy(F.desc("failed_usage_events"), "tool_name")
    )


def support_mttr(support_requests: DataFrame) -> DataFrame:
    return (
        support_requests.groupBy("request_category")
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count_if(F.col("request_status") != "Resolved").alias("unresolved_requests"),
            round_half_up(exact_mean(F.col("resolution_time"))).alias("avg_resolution_hours"),
        )
        .orderBy(F.desc("total_requests"), F.desc_nulls_first("avg_resolution_hours"), "request_category")
    )


def _within(df: DataFrame, table: str, starts: DayZero) -> DataFrame:
    at, key = F.col(schemas.EVENT_DATE[table]), schemas.PRIMARY_KEYS[table]
    df = conform(df, table)
    if key not in df.columns:  # an imported upload has no key
        df = df.withColumn(key, F.lit(None).cast(schemas.SCHEMAS[table][key].dataType))
    in_window = (at >= F.col("joining_date")) & (at <= F.date_add("joining_date", schemas.WINDOW_DAYS))
    return reduce(DataFrame.unionByName, [part.filter(in_window) for part in starts.attach(df, schemas.EVENT_DATE[table])])
