"""Derives the three tables from a generic ``events`` table.

Some dirt is put in on purpose: missing employees, exact copies, null states, completion before start,
negative and missing resolution times, events after Day 30. Every fourth user has a colleague file the requests,
so that some employees have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firstmonth.sources.tables import Tables

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"

_EMPLOYEE = "if(event_id % 101 = 0, null, concat('EMP-', user_id)) as employee_id"
_REQUESTER = "if(event_id % 101 = 0, null, concat('EMP-', user_id + if(user_id % 4 = 0, 1, 0))) as employee_id"
_SHIFTED = "ts + make_dt_interval(cast(floor(value / 10) as int))"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def map_events(events: DataFrame, surrogate_keys: bool = False) -> Tables:
    """Upload shape, or the database shape with unique keys and no doubled rows."""
    return Tables(
        _onboarding(events, surrogate_keys),
        _tool_usage(events, surrogate_keys),
        _support_requests(events, surrogate_keys),
    )


def _onboarding(events: DataFrame, surrogate_keys: bool) -> DataFrame:
    return events.filter("event_type = 'signup'").selectExpr(
        *(["event_id as onboarding_id"] if surrogate_keys else []),
        _EMPLOYEE,
        "concat('Stage-', event_id % 6 + 1) as onboarding_stage",
        """case when event_id % 7 <= 2 then 'Completed'
                when event_id % 7 <= 4 then 'Delayed'
                when event_id % 7 = 5 then 'In Progress'
                else 'Not Started' end as stage_status""",
        "to_date(ts) as start_date",
        """case when event_id % 59 = 0 then date_sub(to_date(ts), 2)
                when event_id % 7 <= 2 or event_id % 14 = 10
                then date_add(to_date(ts), cast(event_id % 9 as int)) end as completion_date""",
    )


def _tool_usage(events: DataFrame, surrogate_keys: bool) -> DataFrame:
    rows = events.filter("event_type in ('click', 'view', 'error')")
    if not surrogate_keys:
        rows = _doubled(rows, 89)
    return rows.selectExpr(
        *(["event_id as usage_id"] if surrogate_keys else []),
        _EMPLOYEE,
        "concat('Tool-', event_id % 9 + 1) as tool_name",
        f"{_SHIFTED} as usage_date",
        "concat('Activity-', event_id % 6 + 1) as usage_activity",
        """case when event_id % 97 = 0 then null
                when event_type != 'error' then 'Success'
                when event_id % 3 = 0 then 'Failed'
                when event_id % 3 = 1 then 'Timeout'
                else 'Permission Denied' end as usage_status""",
    )


def _doubled(rows: DataFrame, every: int) -> DataFrame:
    return rows.selectExpr("*", f"explode(if(event_id % {every} = 0, array(0, 1), array(0))) as copy_no")


def _support_requests(events: DataFrame, surrogate_keys: bool) -> DataFrame:
    rows = events.filter("event_type = 'purchase'")
    if not surrogate_keys:
        rows = _doubled(rows, 83)
    return rows.selectExpr(
        "concat('REQ-', event_id) as request_id",
        _REQUESTER,
        "concat('Category-', event_id % 6 + 1) as request_category",
        f"{_SHIFTED} as request_date",
        """case event_id % 10 when 0 then 'Pending' when 1 then 'In Progress' when 2 then 'Closed'
                else 'Resolved' end as request_status""",
        """case when event_id % 10 > 1
                then if(event_id % 53 = 0, -value, value) end as resolution_time""",
    )
