from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firstmonth.functions import predicates, rounding, sums


def evaluate(spark, values, kind, **columns):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return df.select("x", *[c.alias(n) for n, c in columns.items()]).collect()


def near_ties():
    rng = random.Random(7)
    ties = [k / 2000 for k in range(-3000, 3000)]
    ties += [round(rng.uniform(0, 900), 3) for _ in range(4000)] + [0.125, 1.005, 2.675, 12.25, 0.285, 1e12 + 0.25]
    return ties + [math.nextafter(t, math.inf) for t in ties[::7]] + [math.nextafter(t, -math.inf) for t in ties[::7]]


@pytest.mark.parametrize("digits", [1, 2])
def test_exact_rounding_equals_python_and_scaled_rounding_equals_numpy(spark, digits):
    x = F.col("x")
    rows = evaluate(
        spark,
        near_ties(),
        "double",
        exact=rounding.round_exact(x, digits),
        scaled=rounding.round_scaled(x, digits),
    )
    for row in rows:
        assert row.exact == round(row.x, digits)
        assert row.scaled == np.round(row.x, digits)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(min_value=-1e9, max_value=1e9), min_size=20, max_size=60))
def test_exact_rounding_of_any_number(spark, values):
    x = F.col("x")
    rows = evaluate(
        spark, values, "double", one=rounding.round_exact(x, 1), two=rounding.round_exact(x, 2)
    )
    for row in rows:
        assert (row.one, row.two) == (round(row.x, 1), round(row.x, 2))


def test_one_decimal_text_of_a_rounded_value(spark):
    text = rounding.one_decimal(rounding.round_exact(F.col("x"), 1))
    for row in evaluate(spark, [12.25, 4.0, 100.0, 0.05, -2.25, 33.333], "double", text=text):
        assert row.text == str(round(row.x, 1))


def test_half_up(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 8), (0, 5), (1, 16), (1, 800)], "a bigint, b bigint")
    got = [r[0] for r in df.select(rounding.percent_half_up(F.col("a"), F.col("b"))).collect()]
    assert got == [33.33, 66.67, 12.5, 0.0, 6.25, 0.13]
    df = spark.createDataFrame([(-5, 8), (5, 8), (0, 0), (1, 3), (-1, 200)], "a bigint, b bigint")
    got = [r[0] for r in df.select(rounding.mean_half_up(F.col("a"), F.col("b"))).collect()]
    assert got == [-0.63, 0.63, None, 0.33, -0.01]
    got = evaluate(spark, [0.125, -0.125, 3.0, 2.344], "double", y=rounding.round_half_up(F.col("x")))
    assert [r.y for r in got] == [0.13, -0.13, 3.0, 2.34]


def test_null_differs(spark):
    rows = evaluate(spark, ["Success", "Failed", None], "string", d=predicates.differs(F.col("x"), "Success"))
    assert [r.d for r in rows] == [False, True, True]


def test_strip_equals_python(spark):
    values = [" a ", "\tb\n", " c　", "d e", "", "  ", "\x1cf ", None]
    for row in evaluate(spark, values, "string", s=predicates.strip(F.col("x"))):
        assert row.s == (None if row.x is None else row.x.strip())


def test_numbers_from_text_equal_pandas(spark):
    values = ["abc", "nan", " 3 ", "-1", "1e3", "3d", "4f", "0x1p3", "", "+.5", "7.", "inf", "1,5", "--1", None]
    expected = pd.to_numeric(pd.Series(values, dtype=object), errors="coerce")
    rows = evaluate(spark, values, "string", n=predicates.number_or_null(F.col("x")))
    for row, want in zip(rows, expected):
        got = math.nan if row.n is None else row.n
        assert (math.isnan(got) and math.isnan(want)) or got == want, row.x


def test_hours(spark):
    rows = evaluate(
        spark, [None, math.nan, -1.0, 0.0, 2.5], "double", h=predicates.hours_or_zero(F.col("x"))
    )
    assert [r.h for r in rows] == [0.0, 0.0, 0.0, 0.0, 2.5]


def test_first_by_breaks_ties_by_name_and_skips_missing_names(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1), (None, 9)], "name string, n int")
    assert df.agg(predicates.first_by(F.col("name"), F.col("n"))).first()[0] == "a"
    assert df.filter("name is null").agg(predicates.first_by(F.col("name"), F.col("n"))).first()[0] is None


def test_exact_sum_does_not_depend_on_order(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(0, 80), 2) for _ in range(5000)]
    totals = set()
    for _ in range(4):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
        totals.add(df.agg(sums.exact_sum(F.col("x"))).first()[0])
    assert totals == {math.fsum(values)} or totals == {round(math.fsum(values), 2)}


def test_exact_sum_of_large_and_missing_numbers(spark):
    def total(*values):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        return df.agg(sums.exact_sum(F.col("x")), sums.exact_mean(F.col("x"))).first()

    assert tuple(total(math.inf, 1.0)) == (math.inf, math.inf)
    assert tuple(total(1e30, 1.0)) == (1e30 + 1.0, 5e29)
    assert tuple(total(None, None)) == (None, None)
    assert tuple(total(1.5, None)) == (1.5, 1.5)


def test_exact_sums_do_not_overflow(spark):
    def total(df):
        return df.agg(sums.exact_sum(F.col("x"))).first()[0]

    assert total(spark.createDataFrame([(9e19,)] * 3, "x double")) == 2.7e20
    assert total(spark.range(200_000).select(F.lit(9e14).alias("x"))) == 1.8e20
    assert total(spark.createDataFrame([(9e43,)] * 3, "x double")) == pytest.approx(2.7e44)  # plain addition
    merged = spark.range(200_000).select(F.lit(9e14).alias("x"), (F.col("id") % 7).alias("g"))
    merged = merged.groupBy("g").agg(sums.exact_parts(F.col("x")).alias("p"))
    assert merged.agg(sums.parts_total(sums.merged_parts(F.col("p")))).first()[0] == 1.8e20
