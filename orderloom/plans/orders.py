"""Orders joined to customers and products, and the order fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import order_value_tier

# Columns of the models and where they come from.
_PRODUCT_COLUMNS = {
    "product_name": "product_name",
    "category": "product_category",
    "price": "unit_price",
    "cost": "unit_cost",
    "profit_margin_pct": "profit_margin_pct",
}
_CUSTOMER_COLUMNS = {
    "full_name": "customer_name",
    "email": "customer_email",
    "country": "customer_country",
}
_ENRICHED_COLUMNS = [
    "order_id", "customer_id", "product_id",
    "customer_name", "customer_email", "customer_country",
    "product_name", "product_category", "unit_price", "unit_cost", "profit_margin_pct",
    "quantity", "status",
    "order_total", "order_cost", "order_profit",
    "order_date", "order_date_day", "order_year", "order_month", "order_day_of_week",
    "_loaded_at",
]
_FACT_COLUMNS = [
    "order_id", "customer_id", "product_id",
    "customer_name", "customer_country",
    "product_name", "product_category",
    "quantity", "unit_price", "unit_cost", "order_total", "order_cost", "order_profit",
    "profit_margin_pct", "status",
    "order_date", "order_date_day", "order_year", "order_month", "order_day_of_week",
]


def priced_orders(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Staged orders with product attributes and amounts; orders of unknown products stay.

    This is all the dimension metrics need, so they can do without the join to customers.
    No join here is forced to broadcast: Spark does that where the known size allows it, and
    elsewhere adaptive execution splits the partitions that a frequent key makes too large.
    """
    price, cost, quantity = F.col("unit_price"), F.col("unit_cost"), F.col("quantity")
    return _look_up(orders, products, "product_id", _PRODUCT_COLUMNS).withColumns(
        {
            "order_total": _amount(price * quantity),
            "order_cost": _amount(cost * quantity),
            "order_profit": _amount((price - cost) * quantity),
        }
    )


def int_orders_enriched(
    orders: DataFrame, customers: DataFrame, products: DataFrame
) -> DataFrame:
    """Staged orders with customer and product attributes; orders without a match stay."""
    priced = priced_orders(orders, products)
    enriched = _look_up(priced, customers, "customer_id", _CUSTOMER_COLUMNS)
    return enriched.select(*_ENRICHED_COLUMNS)


def fct_orders(enriched: DataFrame) -> DataFrame:
    """One row per order, with a completion flag and a value tier."""
    return enriched.select(
        *_FACT_COLUMNS,
        F.coalesce(F.col("status") == "completed", F.lit(False)).alias("is_completed"),
        order_value_tier(F.col("order_total")).alias("order_value_tier"),
    )


def _look_up(df: DataFrame, other: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Left join of attributes of ``other``, which is unique by the key.

    The hash of the key is a second join column. It changes no result, but makes the join shuffle
    both sides for itself alone. Staged rows are already partitioned by their key, and Spark would
    join them in place, or group the joined rows by the key in place; adaptive execution can split
    neither, and a key with a third of all orders would keep one task busy. The price is a shuffle of both
    sides even where they are bucketed or partitioned by the key already.
    """
    attributes = other.select(
        F.col(key).alias("_key"), *(F.col(c).alias(name) for c, name in columns.items())
    )
    same = (F.col(key) == F.col("_key")) & (F.xxhash64(key) == F.xxhash64("_key"))
    return df.join(attributes, same, "left").drop("_key")


def _amount(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(18,2)")
