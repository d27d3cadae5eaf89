"""Small hand-made tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.sources.event_mapping import map_events, read_events
from firstmonth.sources.tables import Tables

COLUMNS = {
    schemas.ONBOARDING: ["employee_id", "onboarding_stage", "stage_status", "start_date", "completion_date"],
    schemas.TOOL_USAGE: ["employee_id", "tool_name", "usage_date", "usage_activity", "usage_status"],
    schemas.SUPPORT_REQUESTS: [
        "request_id",
        "employee_id",
        "request_category",
        "request_date",
        "request_status",
        "resolution_time",
    ],
}


def day(n):
    """Day n of January 2026, counted from 0 = 5 January; may go beyond the month."""
    return date.fromordinal(date(2026, 1, 5).toordinal() + n)


def moment(n, hour=0, second=0):
    d = day(n)
    return datetime(d.year, d.month, d.day, hour, 0, second)


def frame(spark, table, rows):
    fields = {f.name: f.dataType.simpleString() for f in schemas.SCHEMAS[table]}
    ddl = ", ".join(f"{name} {fields[name]}" for name in COLUMNS[table])
    return spark.createDataFrame(rows, ddl)


def onboarding(spark, *rows):
    """(employee, stage, status, start, completion)"""
    return frame(spark, schemas.ONBOARDING, list(rows))


def tool_usage(spark, *rows):
    """(employee, tool, moment, status)"""
    return frame(spark, schemas.TOOL_USAGE, [(e, t, at, "Use", s) for e, t, at, s in rows])


def support(spark, *rows):
    """(id, employee, category, moment, status, hours)"""
    return frame(spark, schemas.SUPPORT_REQUESTS, list(rows))


def tables(spark, onb=(), tool=(), sup=()):
    return Tables(onboarding(spark, *onb), tool_usage(spark, *tool), support(spark, *sup))


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by(df, key):
    return {row[key]: row.asDict() for row in df.collect()}


def skewed(spark, sf_dir):
    """The event tables with one employee holding more than a third of all rows, many of them copies."""
    t = map_events(read_events(spark, sf_dir))

    def more(df):
        hot = df.limit(1).select(*[F.lit("EMP-HOT").alias(c) if c == "employee_id" else F.col(c) for c in df.columns])
        copies = hot.crossJoin(spark.range(2500)).drop("id")
        others = df.filter(F.xxhash64(*df.columns) % 3 == 0).withColumn("employee_id", F.lit("EMP-HOT"))
        return df.unionByName(copies).unionByName(others)

    return Tables(*(more(df) for _, df in t.items()))
