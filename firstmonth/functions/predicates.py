"""Null-safe tests and coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"

_OFFSET = r"(?i)\d:\d\d.*(z|utc|gmt|[+-]\d{1,2}(:?\d\d)?)\s*$"


def differs(column: Column, value: str) -> Column:
    """``column != value`` where a null counts as different."""
    return ~column.eqNullSafe(F.lit(value))


def strip(column: Column) -> Column:
    """Trim every kind of white space; nulls stay null."""
    return F.btrim(column, F.lit(WHITESPACE))


def blank_to_null(column: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(strip(column), F.lit(""))


def number_or_null(column: Column) -> Column:
    """Text to double; anything that is not a plain decimal number becomes null."""
    return F.when(column.rlike(_NUMBER), strip(column).try_cast("double"))


def moment_or_raise(column: Column) -> Column:
    """Text to a UTC timestamp without a zone; text with an offset is moved to UTC (in a UTC session). Blank is null."""
    column = blank_to_null(column)
    moved = column.cast("timestamp").cast("timestamp_ntz")
    return F.when(column.rlike(_OFFSET), moved).otherwise(column.cast("timestamp_ntz"))


def hours_or_zero(column: Column) -> Column:
    """Missing, NaN and negative hours become 0."""
    hours = F.nanvl(column.cast("double"), F.lit(None).cast("double"))
    return F.greatest(F.coalesce(hours, F.lit(0.0)), F.lit(0.0))


def first_by(name: Column, *descending: Column) -> Column:
    """Aggregate: the name with the greatest metrics; equal metrics go to the lowest name."""
    ranked = F.struct(*[-metric for metric in descending], name)
    return F.min_by(name, F.when(name.isNotNull(), ranked))
