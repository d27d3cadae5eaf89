"""The three rounding rules of the reports, as Column expressions.

``round_scaled``   scale, round half to even, scale back (array rounding)
``round_exact``    round the exact binary value, half to even (scalar rounding)
``*_half_up``      decimal half away from zero (SQL ``ROUND`` on NUMERIC)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 10 and 100 as sums of powers of two: multiplying a double by such a part is exact.
_POWER_PARTS = {1: (8.0, 2.0), 2: (64.0, 32.0, 4.0)}


def round_scaled(x: Column, digits: int) -> Column:
    """Half-even rounding of ``x * 10^digits``, the way array libraries do it."""
    scale = 10.0**digits
    return F.rint(x * scale) / scale


def round_exact(x: Column, digits: int) -> Column:
    """Round the exact binary value of ``x`` half to even.

    ``x * 10^digits`` itself is rounded, which can fake a tie (2.675 * 100 gives 267.5, yet 2.675 is
    stored below it). Only then does the error of the product matter. Taking the exact parts of the
    product away one by one is free of rounding, as each step subtracts numbers within a factor of two
    of each other, and leaves that error.
    """
    scale = 10.0**digits
    product = x * scale
    excess = product
    for part in _POWER_PARTS[digits]:
        excess = excess - x * part
    nearest = F.rint(product)
    false_tie = (F.abs(product - nearest) == 0.5) & (excess != 0)
    return F.when(false_tie, product - F.signum(excess) * 0.5).otherwise(nearest) / scale


def percent_half_up(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to two digits, half up, in integer arithmetic; ``part`` is not negative."""
    return F.call_function("div", part * 20000 + whole, whole * 2) / 100.0


def mean_half_up(total: Column, n: Column) -> Column:
    """Mean of integers to two digits, half away from zero; null when ``n`` is 0."""
    n = F.nullif(n, F.lit(0))
    return F.signum(total.cast("double")) * F.call_function("div", F.abs(total) * 200 + n, n * 2) / 100.0


def round_half_up(x: Column) -> Column:
    """A double to two digits, half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100.0


def one_decimal(x: Column) -> Column:
    """Text of a value that was already rounded to one digit, e.g. ``12.0`` or ``3.5``."""
    return F.format_string("%.1f", x)
