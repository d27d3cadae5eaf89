"""Registered queries that store rows and read back what became of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.operators import by_employee, kept_day_zero
from firstmonth.plans.first_month import prepare
from firstmonth.sources import enforced, fingerprints, saved, sinks
from firstmonth.sources.event_mapping import map_events, read_events
from firstmonth.sources.tables import Tables
from firstmonth.sources.uploads import read_upload

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    registered: dict[str, Query] = {}
    for name in schemas.TABLE_NAMES:
        registered[f"append_enforced_{name}"] = lambda spark, sf_dir, name=name: append_enforced(spark, sf_dir, name)
        registered[f"clean_{name}_bucketed"] = lambda spark, sf_dir, name=name: getattr(_by_employee(spark, sf_dir), name)
    registered["append_dedup_tool_usage"] = append_dedup_tool_usage
    registered["day_zero_incremental"] = day_zero_incremental
    registered["clean_tool_usage_kept_day_zero"] = clean_tool_usage_kept_day_zero
    registered["csv_import_onboarding_other_dates"] = csv_import_onboarding_other_dates
    registered["upload_refusals"] = upload_refusals
    return registered


def new_database(spark: SparkSession) -> str:
    name = f"run_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{saved.run_folder(spark)}/{name}'")
    return name


def _database(spark: SparkSession, sf_dir: str) -> Tables:
    return map_events(read_events(spark, sf_dir), surrogate_keys=True)


def _number(key: str) -> Column:
    return F.regexp_extract(F.col(key).cast("string"), r"\d+", 0).cast("bigint")


def append_enforced(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Two appends: every second row, some of them again and some keys with another employee; then all rows.

    One line a stored row (``batch`` 0), and one a distinct refused row of either append with its rules and copies.
    """
    database, key = new_database(spark), schemas.PRIMARY_KEYS[table]
    sinks.create_tables(spark, database)
    rows = getattr(_database(spark, sf_dir), table)
    again = rows.where(_number(key) % 14 == 0)
    other = again.withColumn("employee_id", F.lit("EMP-0"))
    first = rows.where(_number(key) % 2 == 0).unionByName(again).unionByName(other)
    results = [enforced.append_enforced(batch, database, table) for batch in (first, rows)]
    refused = [r.rejects.withColumn("batch", F.lit(i + 1)) for i, r in enumerate(results)]
    stored = spark.table(f"{database}.{table}").select(
        "*", F.array().cast("array<string>").alias("broken_rules"), F.lit(1).cast("bigint").alias("copies"), F.lit(0).alias("batch")
    )
    return reduce(DataFrame.unionByName, [stored, *refused]).withColumn("broken_rules", F.array_join("broken_rules", ","))


def _by_employee(spark: SparkSession, sf_dir: str) -> Tables:
    """The first month of a layout by employee."""
    database = new_database(spark)
    by_employee.store(map_events(read_events(spark, sf_dir)), database)
    return by_employee.first_month(spark, database)


def append_dedup_tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the tool rows with some copies under other keys, then all of them again: each is stored once."""
    database = new_database(spark)
    sinks.create_tables(spark, database)
    rows = _database(spark, sf_dir).tool_usage
    copies = rows.where("usage_id % 89 = 0").withColumn("usage_id", -1 - F.col("usage_id"))
    for batch in (rows.where("usage_id % 3 > 0").unionByName(copies), rows):
        fingerprints.append_distinct(batch, database, schemas.TOOL_USAGE)
    return spark.table(f"{database}.{schemas.TOOL_USAGE}")


def _in_three_appends(spark: SparkSession, sf_dir: str) -> tuple[str, Tables]:
    """A database whose Day 0 has seen late rows, then rows without a date and early ones, then the rest."""
    database, tables = new_database(spark), map_events(read_events(spark, sf_dir))
    late, early = F.lit("2024-05-01").cast("date"), F.lit("2024-02-01").cast("date")
    for number in range(3):
        parts = []
        for name, df in tables.items():
            at = F.to_date(schemas.EVENT_DATE[name])
            which = F.when(at >= late, 0).when(at.isNull() | (at < early), 1).otherwise(2)
            parts.append(df.where(which == number))
        kept_day_zero.merge(Tables(*parts), database)
    return database, tables


def day_zero_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day 0 kept over three appends, the second of which brings earlier days."""
    database, _ = _in_three_appends(spark, sf_dir)
    return kept_day_zero.kept_days(spark, database).drop("source_rows")


def clean_tool_usage_kept_day_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first month of the tool rows by a Day 0 that was kept."""
    database, tables = _in_three_appends(spark, sf_dir)
    return prepare(tables, day_zero=kept_day_zero.load(spark, database)).tables.tool_usage


def csv_import_onboarding_other_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload with dates like 31.12.2024 whose rows end early where their last cells are missing."""
    rows = map_events(read_events(spark, sf_dir)).onboarding
    cells = [F.date_format(c, "dd.MM.yyyy") if kind == "date" else F.col(c) for c, kind in rows.dtypes]
    line = F.regexp_replace(F.array_join(F.array(*cells), ",", ""), ",+$", "")
    folder, database = saved.new_folder(spark, "onboarding-text"), new_database(spark)
    rows.select(line.alias("line")).toDF(",".join(rows.columns)).write.csv(folder, header=True, sep="\u0001")
    sinks.replace_table(read_upload(spark, folder, schemas.ONBOARDING), database, schemas.ONBOARDING)
    return spark.table(f"{database}.{schemas.ONBOARDING}")


def upload_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said to uploads of each table without rows, and of each without one required column; and of no rows at all."""
    said = []
    tables = map_events(read_events(spark, sf_dir))
    for name, df in tables.items():
        column = schemas.REQUIRED_COLUMNS[name][1]
        for case, upload in (("no rows", df.limit(0)), ("no column", df.drop(column))):
            folder = saved.new_folder(spark, "refused")
            upload.write.csv(folder, header=True)
            try:
                read_upload(spark, folder, name)
                said.append((name, case, None))
            except ValueError as refusal:
                said.append((name, case, str(refusal)))
    empty = Tables(*(df.where(F.lit(False)) for _, df in tables.items()))
    said.append(("all", "has rows", f"{tables.has_rows()}, {empty.has_rows()}"))
    lines = [F.struct(*[F.lit(x).alias(c) for x, c in zip(line, ("table_name", "upload", "message"))]) for line in said]
    return spark.range(1).select(F.inline(F.array(*lines)))
