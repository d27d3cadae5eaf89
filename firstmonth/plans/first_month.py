"""From raw tables to the cleaned first month."""

from __future__ import annotations

from dataclasses import dataclass

from firstmonth.operators.cleaning import clean_tables
from firstmonth.operators.cohort import stage_cohort
from firstmonth.operators.day_zero import (
    BROADCAST_BYTES,
    HEAVY_ROWS,
    DayZero,
    day_zero_candidates,
    earliest_days,
    measure,
)
from firstmonth.sources.tables import Tables, conform


@dataclass(frozen=True)
class FirstMonth:
    """The raw tables, Day 0 of every employee, and the cleaned tables (lazy)."""

    raw: Tables
    day_zero: DayZero
    tables: Tables
    ignore_keys: bool = False

    def cohort(self, stage: str) -> FirstMonth:
        """The same for the employees seen at ``stage``.

        The large tables are not joined a second time: Day 0 is cut to the cohort, and the join that
        cleans a table drops everyone else.
        """
        day_zero = self.day_zero.restricted_to(stage_cohort(self.tables.onboarding, stage))
        return _first_month(self.raw, day_zero, self.ignore_keys)


def prepare(
    raw: Tables,
    ignore_keys: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    heavy_rows: int = HEAVY_ROWS,
    day_zero: DayZero | None = None,
) -> FirstMonth:
    """Compute Day 0 once (one job over two columns per table), unless it is given; everything after it is lazy."""
    raw = Tables(*(conform(df, name) for name, df in raw.items()))
    if day_zero is None:
        day_zero = measure(earliest_days(day_zero_candidates(raw)), broadcast_bytes, heavy_rows)
    return _first_month(raw, day_zero, ignore_keys)


def _first_month(raw: Tables, day_zero: DayZero, ignore_keys: bool) -> FirstMonth:
    return FirstMonth(raw, day_zero, clean_tables(raw, day_zero, ignore_keys), ignore_keys)
