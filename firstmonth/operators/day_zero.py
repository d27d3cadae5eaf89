"""Day 0 of every employee, and how the three large tables get it.

Day 0 has one row per employee and the tables may have a thousand times more, with one employee
holding any share of them. So Day 0 is computed once, kept as a checkpoint, and measured while it is
written. The measured size decides how a table is joined to it:

* it fits the broadcast bound: map-side join, the table is not shuffled at all;
* it does not fit: employees with very many rows ("heavy") are joined map-side against their own short
  list, whose length is bounded by ``total rows / heavy rows``; the others, each with a bounded
  number of rows, are shuffled by employee.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from firstmonth import schemas
from firstmonth.sources.shared import shared_folder
from firstmonth.sources.tables import Tables

BROADCAST_BYTES = 256 * 1024 * 1024
HEAVY_ROWS = 5_000_000
_ROW_OVERHEAD = 192  # upper estimate of the bytes a broadcast row takes besides its key, which is stored twice


@dataclass(frozen=True)
class DayZero:
    """Day 0 per employee (employee_id, joining_date, source_rows) with its measured size."""

    frame: DataFrame
    employees: int
    source_rows: int
    most_rows: int  # of one employee
    size_bytes: int
    largest_row_bytes: int
    first_day: date | None
    last_day: date | None
    broadcast_bytes: int = BROADCAST_BYTES
    heavy_rows: int = HEAVY_ROWS

    @property
    def fits_broadcast(self) -> bool:
        return self.size_bytes <= self.broadcast_bytes

    @property
    def heavy_threshold(self) -> int:
        """Rows above which an employee is heavy: at most ``source_rows / threshold`` of them exist,
        and their list must fit the broadcast bound as well."""
        bound = self.source_rows * self.largest_row_bytes // max(self.broadcast_bytes, 1)
        return max(self.heavy_rows, bound)

    @property
    def dates(self) -> DataFrame:
        return self.frame.select("employee_id", "joining_date")

    def attach(self, facts: DataFrame, date_column: str) -> list[DataFrame]:
        """``facts`` with ``joining_date``; rows of unknown or missing employees go, and some rows that
        lie outside every first month.

        The parts have no employee in common. Their union is the result.
        """
        facts = facts.filter(F.col("employee_id").isNotNull()).filter(self._in_any_window(date_column))
        if self.fits_broadcast:
            return [facts.join(F.broadcast(self.dates), "employee_id")]
        if self.most_rows <= self.heavy_threshold:
            return [facts.join(self.dates.hint("merge"), "employee_id")]
        is_heavy = F.col("source_rows") > self.heavy_threshold
        heavy = self.frame.filter(is_heavy).select("employee_id", "joining_date")
        others = self.frame.filter(~is_heavy).select("employee_id", "joining_date")
        light_facts = facts.join(F.broadcast(heavy.select("employee_id")), "employee_id", "left_anti")
        return [
            facts.join(F.broadcast(heavy), "employee_id"),
            light_facts.join(others.hint("merge"), "employee_id"),
        ]

    def _in_any_window(self, date_column: str) -> Column:
        return in_any_window(date_column, self.first_day, self.last_day)

    def restricted_to(self, employees: DataFrame) -> DayZero:
        """Day 0 of the given employees only."""
        kept = self.frame.join(employees.select("employee_id").distinct(), "employee_id", "left_semi")
        return measure(kept, self.broadcast_bytes, self.heavy_rows)


def in_any_window(date_column: str, first_day: date | None, last_day: date | None) -> Column:
    """Constant bounds that reach the scan; they skip much when Day 0 covers a cohort or a few months."""
    if first_day is None or last_day is None:
        return F.lit(False)
    end = last_day + timedelta(days=schemas.WINDOW_DAYS + 1)
    return (F.col(date_column) >= F.lit(first_day)) & (F.col(date_column) < F.lit(end))


def day_zero_candidates(tables: Tables) -> DataFrame:
    """(employee_id, day) of every row of all three tables."""
    frames = [_dated(df, schemas.EVENT_DATE[name]) for name, df in tables.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def day_zero(tables: Tables) -> DataFrame:
    """Earliest day of each employee in any table."""
    return earliest_days(day_zero_candidates(tables)).drop("source_rows")


def earliest_days(candidates: DataFrame) -> DataFrame:
    """Earliest day and number of rows per employee; rows are merged before the shuffle."""
    return (
        candidates.filter(F.col("employee_id").isNotNull())
        .groupBy("employee_id")
        .agg(F.min("day").alias("joining_date"), F.count(F.lit(1)).alias("source_rows"))
        .filter(F.col("joining_date").isNotNull())
    )


def onboarding_start_dates(onboarding: DataFrame) -> DataFrame:
    """Earliest onboarding start and number of rows per employee; the other tables do not count."""
    return earliest_days(_dated(onboarding, "start_date"))


def measure(
    frame: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, heavy_rows: int = HEAVY_ROWS
) -> DayZero:
    """Checkpoint a per-employee table and take its size in the same job."""
    shared_folder(frame.sparkSession)
    row_bytes = F.octet_length("employee_id").cast("bigint") * 2 + _ROW_OVERHEAD
    sizes = Observation()
    saved = frame.observe(
        sizes,
        F.count(F.lit(1)).alias("employees"),
        _sum(F.col("source_rows")).alias("source_rows"),
        F.coalesce(F.max("source_rows"), F.lit(0)).alias("most_rows"),
        _sum(row_bytes).alias("size_bytes"),
        F.coalesce(F.max(row_bytes), F.lit(0)).alias("largest_row_bytes"),
        F.min("joining_date").alias("first_day"),
        F.max("joining_date").alias("last_day"),
    ).checkpoint()
    return DayZero(saved, broadcast_bytes=broadcast_bytes, heavy_rows=heavy_rows, **sizes.get)


def _dated(df: DataFrame, date_column: str) -> DataFrame:
    return df.select("employee_id", F.to_date(date_column).alias("day"))


def _sum(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))
