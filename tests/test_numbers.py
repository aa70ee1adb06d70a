"""Rounding of ratios against fractions, and of the same ratios in the check SQL."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import oracle
from tillwise.functions.numbers import percent, percent_change, rounded_ratio


def by_fractions(above, below, digits=2, factor=1):
    if above is None or not below:
        return None
    exact = abs(Fraction(above) * factor / Fraction(below)) * 10**digits
    steps = (2 * exact.numerator + exact.denominator) // (2 * exact.denominator)
    # the exact number of steps, as far as a DOUBLE can say it
    return float(steps if (above >= 0) == (below > 0) else -steps) / 10**digits


def amounts():
    dice = random.Random(4)
    rows = [
        (Decimal("2000000000.01"), 2), (Decimal("-2000000000.01"), 2), (Decimal("90071992547409.91"), 200), (Decimal("9007199254741.01"), 2),
        (Decimal("0.01"), 2), (Decimal("0.01"), 200), (Decimal("1.00"), 0), (None, 3), (Decimal("5.00"), None), (Decimal("0.00"), 7),
        (Decimal("10.05"), 10), (Decimal("2.01"), -2), (Decimal("-2.01"), -2),
    ]
    for _ in range(400):
        size = dice.choice([10**2, 10**5, 10**11, 10**13])
        rows.append((Decimal(dice.randrange(-size, size)).scaleb(-2), dice.choice([2, 4, 8, 20, 200, dice.randrange(1, 10**6)])))
    return rows


def test_ties_of_any_size(spark):
    rows = amounts()
    frame = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "n int, a decimal(28,2), b long")
    a, b = F.col("a"), F.col("b")
    found = frame.select(
        "n", rounded_ratio(a, b), rounded_ratio(a, b, 0), rounded_ratio(a, b, 1, 12), percent(a, b), percent_change(a, b)
    ).orderBy("n").collect()
    for (above, below), row in zip(rows, found):
        change = None if above is None or below is None else above - below
        assert tuple(row)[1:] == (
            by_fractions(above, below), by_fractions(above, below, 0), by_fractions(above, below, 1, 12),
            by_fractions(above, below, 2, 100), by_fractions(change, below, 2, 100),
        ), (above, below)
    assert found[0][1] == 1000000000.01 and found[1][1] == -1000000000.01


def test_amounts_over_amounts_and_counts(spark):
    frame = spark.createDataFrame([(Decimal("0.35"), Decimal("0.40"), 7, 8)], "a decimal(18,2), b decimal(18,2), n long, m int")
    (row,) = frame.select(percent(F.col("a"), F.col("b")), rounded_ratio(F.col("n"), F.col("m")), rounded_ratio(F.col("a"), F.lit(2))).collect()
    assert tuple(row) == (87.5, 0.88, 0.18)


@pytest.mark.parametrize("digits, factor", [(2, 1), (0, 1), (1, 12), (2, 100)])
def test_check_sql_rounds_the_same(digits, factor):
    connection = duckdb.connect()
    for above, below in amounts():
        a, b = (f"CAST({'NULL' if x is None else x} AS {kind})" for x, kind in ((above, "DECIMAL(28,2)"), (below, "BIGINT")))
        (found,) = connection.execute(f"SELECT {oracle.exact(a, b, digits, factor)} AS x").fetchone()
        assert found == by_fractions(above, below, digits, factor), (above, below)


def test_half_away_from_zero_is_half_up_of_amounts():
    for cents in range(-300, 300):
        want = (Decimal(cents) / 200).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert by_fractions(Decimal(cents).scaleb(-2), 2) == float(want)
