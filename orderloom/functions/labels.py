"""Labels for orders, customers and products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lowest value of each label, highest first, and the label below all of them.
ORDER_VALUE = ([(300, "High"), (100, "Medium")], "Low")
SEGMENT = ([(500, "Platinum"), (250, "Gold"), (100, "Silver")], "Bronze")
SALES = ([(10, "Best Seller"), (5, "Good Performer"), (1, "Moderate")], "No Sales")
PRICE = ([(200, "Premium"), (100, "Mid-Range"), (50, "Economy")], "Budget")

# Days since the last order.
ACTIVE_DAYS = 90
AT_RISK_DAYS = 180

_Scale = tuple[list[tuple[int, str]], str]


def _label(value: Column, scale: _Scale) -> Column:
    """First label whose lowest value is reached; a null value gets the lowest label."""
    steps, lowest = scale
    reached = reduce(lambda acc, s: acc.when(value >= s[0], s[1]), steps, F)
    return reached.otherwise(lowest)


def order_value_tier(order_total: Column) -> Column:
    return _label(order_total, ORDER_VALUE)


def customer_segment(lifetime_value: Column) -> Column:
    return _label(lifetime_value, SEGMENT)


def sales_tier(quantity_sold: Column) -> Column:
    return _label(quantity_sold, SALES)


def price_segment(price: Column) -> Column:
    return _label(price, PRICE)


def activity_status(last_order: Column, total_orders: Column, as_of: Column) -> Column:
    """Label by time since the last order, seen from the date ``as_of``."""
    return (
        F.when(last_order >= F.date_sub(as_of, ACTIVE_DAYS), "Active")
        .when(last_order >= F.date_sub(as_of, AT_RISK_DAYS), "At Risk")
        .when(total_orders > 0, "Churned")
        .otherwise("Never Purchased")
    )
