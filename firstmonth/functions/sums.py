"""Sums of fractional numbers that do not depend on the order of the rows.

A number is cut into a multiple of 2^20 and a rest, both kept as decimals and added apart: adding decimals gives the same
total in any order and after any retry. Only what no decimal holds (infinities, NaN, about 1e44 and more, or totals
like that) falls back to plain addition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = float(1 << 20)


def _high(x: Column) -> Column:
    return (x / _STEP).try_cast("decimal(38,0)")


def _low(x: Column) -> Column:
    return (x - _high(x).cast("double") * _STEP).try_cast("decimal(38,18)")


def exact_parts(x: Column) -> Column:
    """Aggregate: the sums of doubles ``x`` as a struct that ``merged_parts`` adds up further."""
    high, low = F.try_sum(_high(x)), F.try_sum(_low(x))
    overflown = (F.count(x) > 0) & (high.isNull() | low.isNull())
    beyond = F.count_if(x.isNotNull() & (_high(x).isNull() | _low(x).isNull())) + overflown.cast("int")
    return F.struct(high.alias("high"), low.alias("low"), beyond.alias("beyond"), F.sum(x).alias("plain"))


def row_parts(x: Column) -> Column:
    """The parts of one number, as ``exact_parts`` makes them of many."""
    high, low = _high(x), _low(x)
    beyond = (x.isNotNull() & (high.isNull() | low.isNull())).cast("bigint")
    return F.struct(high.alias("high"), low.alias("low"), beyond.alias("beyond"), x.alias("plain"))


def merged_parts(parts: Column) -> Column:
    """Aggregate: the sum of structs made by ``exact_parts``."""
    return F.struct(
        F.try_sum(parts["high"]).alias("high"),
        F.try_sum(parts["low"]).alias("low"),
        F.sum(parts["beyond"]).alias("beyond"),
        F.sum(parts["plain"]).alias("plain"),
    )


def parts_total(parts: Column) -> Column:
    """The total as a double; null without any number."""
    total = parts["high"].cast("double") * _STEP + parts["low"].cast("double")
    return F.coalesce(F.when(parts["beyond"] == 0, total), parts["plain"])


def exact_sum(x: Column) -> Column:
    """Aggregate: total of doubles; null without any."""
    return parts_total(exact_parts(x))


def exact_mean(x: Column) -> Column:
    """Aggregate: mean of doubles; null without any."""
    return F.try_divide(exact_sum(x), F.count(x))
