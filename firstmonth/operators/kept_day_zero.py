"""Day 0 as kept state: merged with each append instead of taken from all rows again.

The state is a stored table of the database with one row an employee. An append reads its own rows and the state; the
state is replaced by a new version in one catalog call, so a failed merge leaves the old one. Merging the same rows again changes no day;
only the row counts grow, which decide how tables are joined and not what comes out. Rows that are taken out of the tables are not
taken out of the state: build it anew by ``rebuild`` then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstmonth.operators.day_zero import BROADCAST_BYTES, HEAVY_ROWS, DayZero, day_zero_candidates, measure
from firstmonth.sources import sinks
from firstmonth.sources.tables import Tables, conform

STATE = "day_zero_state"


def merge(appended: Tables, database: str) -> None:
    """Take the rows of one append, of any of the three tables, into the state."""
    conformed = Tables(*(conform(df, name) for name, df in appended.items()))
    days = _days(day_zero_candidates(conformed).withColumn("source_rows", F.lit(1).cast("bigint")))
    spark = days.sparkSession
    if spark.catalog.tableExists(f"{database}.{STATE}"):
        before = spark.table(f"{database}.{STATE}").withColumnRenamed("joining_date", "day")
        days = _days(before.unionByName(days.withColumnRenamed("joining_date", "day")))
    sinks.replace_table(days, database, STATE)


def rebuild(tables: Tables, database: str) -> None:
    """The state from all rows, whatever it was."""
    tables.onboarding.sparkSession.sql(f"DROP TABLE IF EXISTS {database}.{STATE}")
    merge(tables, database)


def kept_days(spark: SparkSession, database: str) -> DataFrame:
    """``employee_id``, ``joining_date``, ``source_rows`` of all employees with a day."""
    return spark.table(f"{database}.{STATE}").filter(F.col("joining_date").isNotNull())


def load(
    spark: SparkSession, database: str, broadcast_bytes: int = BROADCAST_BYTES, heavy_rows: int = HEAVY_ROWS
) -> DayZero:
    """For ``plans.first_month.prepare``, which then reads no table to find Day 0."""
    return measure(kept_days(spark, database), broadcast_bytes, heavy_rows)


def _days(rows: DataFrame) -> DataFrame:
    """Earliest day, null until there is one, and number of rows of each employee; merged before the shuffle."""
    return (
        rows.filter(F.col("employee_id").isNotNull())
        .groupBy("employee_id")
        .agg(F.min("day").alias("joining_date"), F.sum("source_rows").alias("source_rows"))
    )
