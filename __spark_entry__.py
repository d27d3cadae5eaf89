"""Registered queries and their SQL counterparts.

``queries()`` holds one query per operator. Each derives the three tables from ``events`` and runs over
all of their rows. ``oracle_sql()`` holds the DuckDB text for the same keys.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracles
import storage_queries
from firstmonth import schemas
from firstmonth.operators import (
    cohort_friction,
    day_zero,
    friction,
    journey,
    onboarding,
    overview,
    quality,
    support,
    tools,
    views,
)
from firstmonth.plans.dashboard import Dashboard, build_dashboard
from firstmonth.plans.first_month import FirstMonth, prepare
from firstmonth.sources import saved, sinks
from firstmonth.sources.event_mapping import map_events, read_events
from firstmonth.sources.tables import Tables, load_tables, register_tables, run_sql
from firstmonth.sources.uploads import read_upload, trim_strings

try:
    import corpus_pipeline
    from firstmonth.llm import registry as training_data
except ModuleNotFoundError as missing:  # the package for training data and its pipeline can be left out
    if missing.name not in ("corpus_pipeline", "firstmonth.llm"):
        raise
    training_data = corpus_pipeline = None

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"
COHORT_STAGE = "Stage-3"


def entry(spark: SparkSession) -> DataFrame:
    """The ranked friction points of the small data set."""
    return queries()["friction_points"](spark, SMOKE_DIR)


def oracle_sql() -> dict[str, str]:
    if training_data is None:
        return oracles.oracle_sql()
    return {**oracles.oracle_sql(), **training_data.oracle_sql(), **_pipeline_sql()}


def _pipeline_sql() -> dict[str, str]:
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}


def queries() -> dict[str, Query]:
    registered: dict[str, Query] = {}

    for name in schemas.TABLE_NAMES:
        registered[f"load_{name}"] = lambda spark, sf_dir, name=name: getattr(_stored(spark, sf_dir), name)
        registered[f"load_defaults_{name}"] = lambda spark, sf_dir, name=name: getattr(
            _stored(spark, sf_dir, schemas.OPTIONAL_DEFAULTS), name
        )
        registered[f"rejected_{name}"] = _on_uploads(lambda t, name=name: _rejected(getattr(t, name), name))
        registered[f"csv_import_{name}"] = lambda spark, sf_dir, name=name: _csv_import(spark, sf_dir, name)
        registered[f"dedup_{name}"] = _on_uploads(lambda t, name=name: quality.deduplicate(getattr(t, name)))
    registered["append_tool_usage"] = _append_tool_usage
    registered["clear_tables"] = _clear_tables
    registered["custom_query"] = _custom_query
    registered["trim_strings"] = _on_uploads(lambda t: trim_strings(_pad(t.tool_usage)))
    registered["audit"] = _on_uploads(quality.audit)
    registered["audit_ignore_keys"] = lambda spark, sf_dir: quality.audit(_stored_again(spark, sf_dir), ignore_keys=True)
    registered["dedup_tool_usage_ignore_keys"] = lambda spark, sf_dir: quality.deduplicate(
        _stored_again(spark, sf_dir).tool_usage, [schemas.SURROGATE_KEYS[schemas.TOOL_USAGE]]
    )
    registered["audit_warnings"] = _on_uploads(quality.audit_warnings)
    registered["constraint_violations"] = _on_uploads(quality.constraint_violations)

    registered["day_zero"] = _on_uploads(day_zero.day_zero)
    registered["clean_onboarding"] = _on_first_month(lambda t: t.onboarding)
    registered["clean_tool_usage"] = _on_first_month(lambda t: t.tool_usage)
    registered["clean_support_requests"] = _on_first_month(lambda t: t.support_requests)
    registered["stage_list"] = _on_first_month(lambda t: onboarding.stage_list(t.onboarding))

    registered["view_employee_start_dates"] = lambda spark, sf_dir: views.employee_start_dates(
        _database(spark, sf_dir).onboarding
    )
    registered["view_first_30_days_onboarding"] = _on_views(
        lambda t, starts: views.first_30_days_onboarding(t.onboarding, starts)
    )
    registered["view_first_30_days_tool_usage"] = _on_views(
        lambda t, starts: views.first_30_days_tool_usage(t.tool_usage, starts)
    )
    registered["view_first_30_days_support"] = _on_views(
        lambda t, starts: views.first_30_days_support(t.support_requests, starts)
    )
    registered["view_sql"] = _view_sql
    registered["sql_stage_delays"] = _on_uploads(lambda t: views.stage_delays(t.onboarding))
    registered["sql_tool_failures"] = _on_uploads(lambda t: views.tool_failures(t.tool_usage))
    registered["sql_support_mttr"] = _on_uploads(lambda t: views.support_mttr(t.support_requests))

    registered["stage_summary"] = _on_first_month(lambda t: onboarding.stage_summary(t.onboarding))
    registered["stage_status_long"] = _on_first_month(
        lambda t: onboarding.stage_status_long(onboarding.stage_summary(t.onboarding))
    )
    registered["onboarding_kpis"] = _on_first_month(lambda t: onboarding.onboarding_kpis(t.onboarding))
    registered["tool_summary"] = _on_first_month(lambda t: tools.tool_summary(t.tool_usage))
    registered["tool_kpis"] = _on_first_month(lambda t: tools.tool_kpis(t.tool_usage))
    registered["tool_support_overlap"] = _on_first_month(
        lambda t: tools.tool_support_overlap(t.tool_usage, t.support_requests)
    )
    registered["support_category_summary"] = _on_first_month(
        lambda t: support.support_category_summary(t.support_requests)
    )
    registered["support_kpis"] = _on_first_month(lambda t: support.support_kpis(t.support_requests))
    registered["support_timeline"] = _on_first_month(lambda t: support.support_timeline(t.support_requests))
    registered["repeated_issues"] = _on_first_month(lambda t: support.repeated_issues(t.support_requests))

    registered["friction_points"] = _on_first_month(friction.friction_points)
    registered["friction_evidence"] = _on_first_month(
        lambda t: friction.friction_evidence(friction.friction_points(t))
    )
    registered["friction_ranked"] = _on_first_month(lambda t: friction.friction_ranked(friction.friction_points(t)))
    registered["primary_bottleneck"] = _on_first_month(
        lambda t: friction.primary_bottleneck(friction.friction_points(t))
    )
    registered["cohort_friction"] = lambda spark, sf_dir: friction.friction_points(
        _first_month(spark, sf_dir).cohort(COHORT_STAGE).tables
    )
    registered["journey_daily"] = _on_first_month(journey.journey_daily)
    registered["journey_weekly_tickets"] = _on_first_month(
        lambda t: journey.journey_weekly_tickets(t.support_requests)
    )
    registered["overview_kpis"] = _on_first_month(overview.overview_kpis)
    for name in schemas.TABLE_NAMES:
        registered[f"overview_kpis_no_{name}"] = _without(name, overview.overview_kpis)
        registered[f"friction_points_no_{name}"] = _without(name, friction.friction_points)
        registered[f"journey_daily_no_{name}"] = _without(name, journey.journey_daily)
    registered["onboarding_kpis_no_onboarding"] = _without(
        schemas.ONBOARDING, lambda t: onboarding.onboarding_kpis(t.onboarding)
    )
    registered["tool_kpis_no_tool_usage"] = _without(schemas.TOOL_USAGE, lambda t: tools.tool_kpis(t.tool_usage))
    registered["support_kpis_no_support_requests"] = _without(
        schemas.SUPPORT_REQUESTS, lambda t: support.support_kpis(t.support_requests)
    )
    registered["friction_points_no_rows"] = _no_friction
    registered["cohort_friction_all"] = _on_first_month(cohort_friction.cohort_friction)
    for frame in oracles.DASHBOARD_FRAMES:
        registered[f"dashboard_{frame}"] = lambda spark, sf_dir, frame=frame: _dashboard(spark, sf_dir).frames()[frame]
    registered["dashboard_cohort_friction"] = lambda spark, sf_dir: _dashboard(spark, sf_dir, COHORT_STAGE).frames()[
        "friction_points"
    ]
    registered.update(storage_queries.queries())
    if training_data is not None:
        registered.update(training_data.queries())
        registered["pipeline"] = corpus_pipeline.run
    return registered


def _uploads(spark: SparkSession, sf_dir: str) -> Tables:
    return map_events(read_events(spark, sf_dir))


def _database(spark: SparkSession, sf_dir: str) -> Tables:
    return map_events(read_events(spark, sf_dir), surrogate_keys=True)


def _first_month(spark: SparkSession, sf_dir: str) -> FirstMonth:
    return prepare(_uploads(spark, sf_dir))


def _dashboard(spark: SparkSession, sf_dir: str, stage: str | None = None) -> Dashboard:
    return build_dashboard(_uploads(spark, sf_dir), stage)


def _stored(spark: SparkSession, sf_dir: str, without: dict[str, Iterable[str]] | None = None) -> Tables:
    """The tables written as Parquet with text columns, fewer of them if named, and read by the loader."""
    root = saved.new_folder(spark, "stored")
    for name, df in _uploads(spark, sf_dir).items():
        text = df.select(*[F.col(column).cast("string").alias(column) for column in df.columns])
        text.drop(*(without or {}).get(name, ())).write.parquet(f"{root}/{name}")
    return load_tables(spark, root)


def _stored_again(spark: SparkSession, sf_dir: str) -> Tables:
    """The database shape, some tool rows a second time under other keys."""
    t = _database(spark, sf_dir)
    again = t.tool_usage.filter("usage_id % 89 = 0").withColumn("usage_id", -1 - F.col("usage_id"))
    return replace(t, tool_usage=t.tool_usage.unionByName(again))


def _rejected(df: DataFrame, table: str) -> DataFrame:
    _, broken = quality.split_violations(df, table)
    return broken.withColumn("broken_rules", F.array_join("broken_rules", ","))


def _without(table: str, operator: Callable[[Tables], DataFrame]) -> Query:
    """``operator`` on the first month when one table has no rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _uploads(spark, sf_dir)
        return operator(prepare(replace(t, **{table: getattr(t, table).filter(F.lit(False))})).tables)

    return run


def _no_friction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking when nothing is delayed, nothing fails and nobody asks."""
    t = _first_month(spark, sf_dir).tables
    calm = Tables(
        t.onboarding.filter("stage_status != 'Delayed'"),
        t.tool_usage.filter("usage_status = 'Success'"),
        t.support_requests.filter(F.lit(False)),
    )
    return friction.friction_points(calm)


def _on_uploads(operator: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_uploads(spark, sf_dir))


def _on_first_month(operator: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_first_month(spark, sf_dir).tables)


def _on_views(operator: Callable[[Tables, day_zero.DayZero], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        database = _database(spark, sf_dir)
        return operator(database, day_zero.measure(day_zero.onboarding_start_dates(database.onboarding)))

    return run


def _custom_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(_uploads(spark, sf_dir))
    sql = "select tool_name, count(*) as n from tool_usage where usage_status = :status group by tool_name"
    return run_sql(spark, sql, {"status": "Failed"})


def _view_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views are created over empty tables, follow what is stored later, and are read by another session."""
    database = storage_queries.new_database(spark)
    sinks.create_tables(spark, database)
    views.register_catalog_views(spark, database)
    for name, df in _database(spark, sf_dir).items():
        sinks.append_rows(df, database, name)
    sql = f"""
        select tool_name, count(*) as events, count(distinct employee_id) as employees
        from {database}.{schemas.VIEW_TOOL_USAGE} where usage_status = :status group by tool_name"""
    return run_sql(spark.newSession(), sql, {"status": "Timeout"})


def _pad(df: DataFrame) -> DataFrame:
    """Blanks around every text value."""
    return df.select(
        *[
            F.concat(F.lit("  "), name, F.lit(" ")).alias(name) if kind == "string" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def _csv_import(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Write the table as CSV with blanks in header and cells, then import it as an upload."""
    database = storage_queries.new_database(spark)
    folder = saved.new_folder(spark, f"{table}-csv")
    text = getattr(_uploads(spark, sf_dir), table)
    text = _pad(text.select(*[F.col(name).cast("string").alias(name) for name in text.columns]))
    text.toDF(*[f" {name} " for name in text.columns]).write.csv(
        folder, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    sinks.replace_table(read_upload(spark, folder, table), database, table)
    return spark.table(f"{database}.{table}")


def _append_tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a new table add up."""
    database = storage_queries.new_database(spark)
    rows = _database(spark, sf_dir).tool_usage
    sinks.create_tables(spark, database)
    sinks.append_rows(rows, database, schemas.TOOL_USAGE)
    sinks.append_rows(rows, database, schemas.TOOL_USAGE)
    return spark.table(f"{database}.{schemas.TOOL_USAGE}")


def _clear_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table after filling all three, and after clearing them."""
    database = storage_queries.new_database(spark)
    sinks.create_tables(spark, database)
    for name, df in _database(spark, sf_dir).items():
        sinks.append_rows(df, database, name)
    before = _row_counts(spark, database, "n_before").checkpoint()
    sinks.clear_tables(spark, database)
    return before.join(_row_counts(spark, database, "n_after"), "table_name")


def _row_counts(spark: SparkSession, database: str, column: str) -> DataFrame:
    counts = [
        spark.table(f"{database}.{name}").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias(column))
        for name in schemas.TABLE_NAMES
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
