from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderloom import functions
from tests.conftest import rows


def evaluate(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def dec(text, kind="decimal(10,2)"):
    return F.lit(text).cast(kind)


@pytest.mark.parametrize(
    "price, cost, expected",
    [
        ("149.99", "75.00", "50.00"),
        ("24.99", "12.50", "49.98"),
        ("8.00", "7.9996", None),  # cost is rounded to 8.00 by its type
        ("200.00", "199.99", "0.01"),  # exactly 0.005 rounds away from zero
        ("200.00", "200.01", "-0.01"),
        ("0.03", "0.01", "66.67"),
        ("10.00", "30.00", "-200.00"),
        ("99999999.99", "99999999.98", "0.00"),
    ],
)
def test_margin(spark, price, cost, expected):
    got = evaluate(spark, functions.margin_pct(dec(price), dec(cost)))
    assert got == (Decimal("0.00") if expected is None else Decimal(expected))


def test_margin_of_free_product_is_null_and_macro_gives_zero(spark):
    assert evaluate(spark, functions.margin_pct(dec("0"), dec("1"))) is None
    assert evaluate(spark, functions.calculate_margin(dec("0"), dec("1"))) == 0
    assert evaluate(spark, functions.calculate_margin(dec(None), dec("1"))) is None
    assert evaluate(spark, functions.calculate_margin(dec("100"), dec(None))) is None
    assert evaluate(spark, functions.calculate_margin(dec("100"), dec("60"))) == 40


def test_integral_division_drops_the_fraction(spark):
    margin = functions.calculate_margin(F.lit(100), F.lit(60), integral=True)
    assert evaluate(spark, margin) == 0
    assert evaluate(spark, functions.calculate_margin(F.lit(10), F.lit(-25), integral=True)) == 300
    assert evaluate(spark, functions.calculate_margin(F.lit(0), F.lit(1), integral=True)) == 0
    assert evaluate(spark, functions.safe_divide(F.lit(7), F.lit(2), integral=True)) == 3
    assert evaluate(spark, functions.safe_divide(F.lit(-7), F.lit(2), integral=True)) == -3


def test_safe_divide(spark):
    null = F.lit(None).cast("double")
    assert evaluate(spark, functions.safe_divide(F.lit(7.0), F.lit(2.0))) == 3.5
    assert evaluate(spark, functions.safe_divide(F.lit(7.0), F.lit(0.0))) == 0
    assert evaluate(spark, functions.safe_divide(F.lit(7.0), null, default=-1)) == -1
    assert evaluate(spark, functions.safe_divide(null, F.lit(2.0))) is None
    assert evaluate(spark, functions.safe_divide(null, F.lit(0.0))) == 0


@pytest.mark.parametrize("day, dow", [("2024-01-05", 5), ("2024-01-07", 0), ("2024-01-06", 6)])
def test_date_parts(spark, day, dow):
    parts = functions.date_parts(F.lit(f"{day} 10:30:00").cast("timestamp_ntz"))
    row = spark.range(1).select(*(c.alias(n) for n, c in parts.items())).first()
    assert tuple(row) == (date.fromisoformat(day), 2024, 1, dow)


def test_date_spine(spark):
    days = functions.date_spine(spark, date(2024, 2, 27), "2024-03-01")
    assert rows(days) == [(date(2024, 2, 27),), (date(2024, 2, 28),), (date(2024, 2, 29),),
                          (date(2024, 3, 1),)]
    assert days.columns == ["date_day"]
    assert functions.date_spine(spark, "2024-01-01", "2024-01-01").count() == 1
    assert functions.date_spine(spark, "2024-01-02", "2024-01-01").count() == 0


LABELS = [
    (functions.order_value_tier, [(None, "Low"), ("99.99", "Low"), ("100", "Medium"),
                                  ("299.99", "Medium"), ("300", "High")]),
    (functions.customer_segment, [(None, "Bronze"), ("99.99", "Bronze"), ("100", "Silver"),
                                  ("249.99", "Silver"), ("250", "Gold"), ("499.98", "Gold"),
                                  ("500", "Platinum")]),
    (functions.sales_tier, [(None, "No Sales"), ("0", "No Sales"), ("1", "Moderate"),
                            ("4", "Moderate"), ("5", "Good Performer"), ("9", "Good Performer"),
                            ("10", "Best Seller")]),
    (functions.price_segment, [(None, "Budget"), ("49.99", "Budget"), ("50", "Economy"),
                               ("100", "Mid-Range"), ("199.99", "Mid-Range"), ("200", "Premium")]),
]


@pytest.mark.parametrize("label, cases", LABELS)
def test_labels(spark, label, cases):
    df = spark.createDataFrame(cases, "v string, expected string")
    got = df.select(label(F.col("v").cast("decimal(10,2)")).alias("got"), "expected")
    assert got.where("got is distinct from expected").count() == 0


@pytest.mark.parametrize(
    "last, total, expected",
    [
        (datetime(2024, 5, 1), 1, "Active"),
        (datetime(2024, 2, 1), 1, "Active"),
        (datetime(2024, 1, 31, 23, 59), 1, "At Risk"),
        (datetime(2023, 11, 3), 1, "At Risk"),
        (datetime(2023, 11, 2, 23, 59), 1, "Churned"),
        (None, 2, "Churned"),
        (None, 0, "Never Purchased"),
        (None, None, "Never Purchased"),
    ],
)
def test_activity(spark, last, total, expected):
    as_of = F.lit("2024-05-01").cast("date")
    status = functions.activity_status(
        F.lit(last).cast("timestamp_ntz"), F.lit(total).cast("bigint"), as_of
    )
    assert evaluate(spark, status) == expected
