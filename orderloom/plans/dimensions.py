"""Customer and product dimensions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import activity_status, customer_segment, price_segment, sales_tier
from orderloom.operators.metrics import customer_metrics, product_metrics


def dim_customers(
    customers: DataFrame, orders: DataFrame, as_of: date | str | None = None
) -> DataFrame:
    """One row per staged customer with lifetime metrics, segment and activity.

    ``orders`` are enriched or priced orders, unique by ``order_id``. ``as_of`` is the date the
    activity is seen from, today by default.
    """
    total, completed = F.col("total_orders"), F.col("completed_orders")
    value, last_order = F.col("lifetime_value"), F.col("last_order_date")
    seen_from = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    joined = customers.join(
        customer_metrics(orders, orders_unique=True), "customer_id", "left"
    )
    return joined.select(
        "customer_id",
        "first_name",
        "last_name",
        "full_name",
        "email",
        "country",
        "customer_created_at",
        _or_zero("total_orders"),
        _or_zero("total_items_purchased"),
        _or_zero("lifetime_value"),
        _or_zero("lifetime_profit"),
        _or_zero("avg_order_value"),
        _or_zero("completed_orders"),
        _or_zero("unique_categories_purchased"),
        "first_order_date",
        last_order,
        F.when(total > 0, completion_rate(completed, total))
        .otherwise(0)
        .cast("decimal(18,2)")
        .alias("order_completion_rate"),
        customer_segment(value).alias("customer_segment"),
        activity_status(last_order, total, seen_from).alias("activity_status"),
    )


def dim_products(products: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per staged product with sales metrics and tiers; ``orders`` as above."""
    joined = products.join(product_metrics(orders, orders_unique=True), "product_id", "left")
    return joined.select(
        "product_id",
        "product_name",
        "category",
        "price",
        "cost",
        "profit_margin_pct",
        "profit_per_unit",
        _or_zero("total_orders"),
        _or_zero("unique_customers"),
        _or_zero("total_quantity_sold"),
        _or_zero("total_revenue"),
        _or_zero("total_profit"),
        _or_zero("avg_order_value"),
        "first_sale_date",
        "last_sale_date",
        sales_tier(F.col("total_quantity_sold")).alias("sales_tier"),
        price_segment(F.col("price")).alias("price_segment"),
    )


def completion_rate(completed: Column, total: Column) -> Column:
    """Completed orders in percent of all orders, two decimals."""
    return F.round(completed.cast("decimal(20,0)") * 100 / total.cast("decimal(20,0)"), 2)


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)
