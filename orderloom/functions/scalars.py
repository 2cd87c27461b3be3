"""Column functions for money, ratios and dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def margin_pct(revenue: Column, cost: Column) -> Column:
    """Profit in percent of revenue with two decimals; null where revenue is 0.

    Multiplying before dividing keeps enough digits for exact rounding of ``decimal(10,2)`` input.
    """
    return F.round((revenue - cost) * 100 / F.nullif(revenue, F.lit(0)), 2)


def calculate_margin(revenue: Column, cost: Column, integral: bool = False) -> Column:
    """Margin in percent, 0 where revenue is 0, null where revenue is null.

    Set ``integral`` when both inputs are integers to divide them as integers, dropping the
    fraction, which is what SQL does with integer operands; Spark's ``/`` would not.
    """
    if integral:
        share = F.call_function("div", revenue - cost, F.nullif(revenue, F.lit(0))) * 100
    else:
        share = margin_pct(revenue, cost)
    return F.when(revenue == 0, F.lit(0)).otherwise(share)


def safe_divide(
    numerator: Column, denominator: Column, default: float = 0, integral: bool = False
) -> Column:
    """Quotient, or ``default`` where the denominator is 0 or null.

    ``integral`` as in ``calculate_margin``.
    """
    divisor = F.nullif(denominator, F.lit(0))
    quotient = F.call_function("div", numerator, divisor) if integral else numerator / divisor
    return F.when(divisor.isNull(), F.lit(default)).otherwise(quotient)


def date_parts(moment: Column) -> dict[str, Column]:
    """Day, year, month and day of week (Sunday is 0) of a timestamp."""
    return {
        "order_date_day": F.to_date(moment),
        "order_year": F.year(moment),
        "order_month": F.month(moment),
        "order_day_of_week": F.dayofweek(moment) - 1,
    }


def spine(bounds: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row ``date_day`` per day from ``start`` to ``end``, both included, per row of bounds."""
    days = F.when(end >= start, F.sequence(start, end, F.expr("interval 1 day")))
    return bounds.select(F.explode(days).alias("date_day"))


def date_spine(spark: SparkSession, start: date | str, end: date | str) -> DataFrame:
    """The days from ``start`` to ``end``; none if ``end`` is earlier."""
    return spine(
        spark.range(1), F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    )
