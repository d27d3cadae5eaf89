"""The three tables and Day 0 stored in buckets by employee, so that the first month is found without a shuffle.

A layout is a database of its own, written once: rows in as many buckets as Day 0, one file a bucket. The window join and
the deduplication then both run inside a bucket. A bucket is read by one task, so rows that would make one uneven
lie beside it in a plain table, in the files they came in ("spread"): those of employees with very many rows, whose list is bounded
like that of ``DayZero.attach``, and those without an employee or a date, which belong to no first month. The task of a bucket sorts
its rows and holds its distinct ones, about 320 bytes a row as measured, so a bucket has few rows and no employee has more than a
part of them. Later rows go into a new layout; readers of the old one are not disturbed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.operators.cleaning import distinct_month, normalised
from firstmonth.operators.day_zero import (
    BROADCAST_BYTES,
    day_zero_candidates,
    earliest_days,
    in_any_window,
    measure,
)
from firstmonth.sources import saved, sinks
from firstmonth.sources.tables import Tables, conform

ROWS_PER_BUCKET = 1_000_000
HEAVY_ROWS = ROWS_PER_BUCKET // 10  # of one employee, beyond which its rows lie beside the buckets
MAX_BUCKETS = 50_000  # Spark refuses more than 100,000
DAYS = "day_zero"


def store(
    tables: Tables,
    database: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    broadcast_bytes: int = BROADCAST_BYTES,
    heavy_rows: int = HEAVY_ROWS,
) -> int:
    """Write the layout into an existing database that has none; the number of buckets."""
    tables = Tables(*(conform(df, name) for name, df in tables.items()))
    days = measure(earliest_days(day_zero_candidates(tables)), broadcast_bytes, heavy_rows)
    buckets = min(MAX_BUCKETS, max(1, -(-days.source_rows // rows_per_bucket)))
    is_heavy = F.col("source_rows") > days.heavy_threshold
    heavy = F.broadcast(days.frame.filter(is_heavy).select("employee_id"))
    _store_spread(days.frame.filter(is_heavy).drop("source_rows"), database, DAYS)
    _store_buckets(days.frame.filter(~is_heavy).drop("source_rows"), database, DAYS, "employee_id", buckets)
    for name, df in tables.items():
        at = schemas.EVENT_DATE[name]
        dated = F.col("employee_id").isNotNull() & F.col(at).isNotNull()
        beside = df.join(heavy.withColumn("_heavy", F.lit(True)), "employee_id", "left").filter(~dated | F.col("_heavy"))
        _store_spread(beside.select(*df.columns), database, name)
        _store_buckets(df.filter(dated).join(heavy, "employee_id", "left_anti").select(*df.columns), database, name, at, buckets)
    return buckets


def stored_rows(spark: SparkSession, database: str, table: str) -> DataFrame:
    """All rows of one table."""
    return spark.table(f"{database}.{table}_buckets").unionByName(spark.table(f"{database}.{table}_spread"))


def first_month(
    spark: SparkSession, database: str, ignore_keys: bool = False, broadcast_bytes: int = BROADCAST_BYTES
) -> Tables:
    """The cleaned tables, equal to those of ``plans.first_month.prepare``.

    Only rows of heavy employees are shuffled, and only to meet their copies. Day 0 is sent to the buckets if its size,
    taken from the stored table, allows; otherwise its buckets are merged with theirs.
    """
    held = spark.table(f"{database}.{DAYS}_buckets").agg(saved.held_bytes("employee_id").alias("held")).first()["held"]
    days = saved.small(spark.table(f"{database}.{DAYS}_buckets"), held, broadcast_bytes)
    heavy = F.broadcast(spark.table(f"{database}.{DAYS}_spread"))
    first, last = stored_rows(spark, database, DAYS).agg(F.min("joining_date"), F.max("joining_date")).first()
    cleaned = []
    for name in schemas.TABLE_NAMES:
        at = schemas.EVENT_DATE[name]
        buckets, spread = (spark.table(f"{database}.{name}_{kind}") for kind in ("buckets", "spread"))
        parts = [
            buckets.filter(in_any_window(at, first, last)).join(days, "employee_id"),
            spread.filter(in_any_window(at, first, last)).join(heavy, "employee_id"),
        ]
        cleaned.append(normalised(distinct_month(parts, buckets.columns, name, ignore_keys), name))
    return Tables(*cleaned)


def _store_buckets(df: DataFrame, database: str, name: str, order: str, buckets: int) -> None:
    """A task writes one bucket, in date order for scans with date bounds."""
    by_bucket = df.repartition(buckets, "employee_id").write.bucketBy(buckets, "employee_id").sortBy(order)
    by_bucket.option("path", _folder(df, database, f"{name}_buckets")).saveAsTable(f"{database}.{name}_buckets")


def _store_spread(df: DataFrame, database: str, name: str) -> None:
    df.write.option("path", _folder(df, database, f"{name}_spread")).saveAsTable(f"{database}.{name}_spread")


def _folder(df: DataFrame, database: str, name: str) -> str:
    return f"{sinks.location(df.sparkSession, database)}/{name}"
