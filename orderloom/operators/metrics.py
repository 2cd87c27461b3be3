"""Order metrics per customer and per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY_SUM = "decimal(28,2)"


def _average(total: Column, count: Column) -> Column:
    """Mean of the non-null amounts with 12 decimals; ``avg`` would keep six."""
    return total.cast(MONEY_SUM) / F.nullif(count, F.lit(0)).cast("decimal(20,0)")


def _per_value(orders: DataFrame, key: str, other: str) -> DataFrame:
    """Amounts once per (key, order) and, with no amounts, once per (key, value of ``other``).

    Both are counted by one grouping of the key, a tag and the value, which spreads the rows of the
    largest key. Spark's own plan for several distinct counts copies every whole row for each of them.
    """
    completed = F.col("status") == "completed"
    given = {"quantity": F.col("quantity"), "total": F.col("order_total"), "profit": F.col("order_profit"),
             "ordered": F.col("order_date"), "completed": completed}
    of_order = F.struct(
        F.lit(True).alias("is_order"),
        F.col("order_id").cast("string").alias("value"),
        *(c.alias(name) for name, c in given.items()),
    )
    # A condition that never holds gives a null of the same type.
    none = {name: F.when(F.lit(False), c) for name, c in given.items()}
    of_other = F.struct(
        F.lit(False).alias("is_order"),
        F.col(other).cast("string").alias("value"),
        *(c.alias(name) for name, c in none.items()),
    )
    rows = orders.select(key, F.inline(F.array(of_order, of_other)))
    return rows.groupBy(key, "is_order", "value").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("total").alias("total"),
        F.count("total").alias("n_totals"),
        F.sum("profit").alias("profit"),
        F.min("ordered").alias("first"),
        F.max("ordered").alias("last"),
        F.max("completed").alias("completed"),
    )


def customer_metrics(orders: DataFrame, orders_unique: bool = False) -> DataFrame:
    """Totals per customer over enriched orders.

    Pass ``orders_unique`` when ``order_id`` is known to be unique, as it is after staging: plain
    counts then equal distinct counts, and one distinct column is left. Spark groups that by
    (customer, category) first, so even the largest customer is spread over many tasks.
    """
    if not orders_unique:
        is_order, value = F.col("is_order"), F.col("value")
        return _per_value(orders, "customer_id", "product_category").groupBy("customer_id").agg(
            F.count_if(is_order & value.isNotNull()).alias("total_orders"),
            F.sum("quantity").alias("total_items_purchased"),
            F.sum("total").cast(MONEY_SUM).alias("lifetime_value"),
            F.sum("profit").cast(MONEY_SUM).alias("lifetime_profit"),
            _average(F.sum("total"), F.sum("n_totals")).alias("avg_order_value"),
            F.min("first").alias("first_order_date"),
            F.max("last").alias("last_order_date"),
            F.count_if(~is_order & value.isNotNull()).alias("unique_categories_purchased"),
            F.count_if(is_order & value.isNotNull() & F.col("completed")).alias("completed_orders"),
        )
    order_id, total = F.col("order_id"), F.col("order_total")
    return orders.groupBy("customer_id").agg(
        F.count(order_id).alias("total_orders"),
        F.sum("quantity").alias("total_items_purchased"),
        F.sum(total).cast(MONEY_SUM).alias("lifetime_value"),
        F.sum("order_profit").cast(MONEY_SUM).alias("lifetime_profit"),
        _average(F.sum(total), F.count(total)).alias("avg_order_value"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.count_distinct("product_category").alias("unique_categories_purchased"),
        F.count(F.when(F.col("status") == "completed", order_id)).alias("completed_orders"),
    )


def product_metrics(orders: DataFrame, orders_unique: bool = False) -> DataFrame:
    """Totals per product over enriched orders; ``orders_unique`` as in ``customer_metrics``."""
    if not orders_unique:
        is_order, value = F.col("is_order"), F.col("value")
        return _per_value(orders, "product_id", "customer_id").groupBy("product_id").agg(
            F.count_if(is_order & value.isNotNull()).alias("total_orders"),
            F.count_if(~is_order & value.isNotNull()).alias("unique_customers"),
            F.sum("quantity").alias("total_quantity_sold"),
            F.sum("total").cast(MONEY_SUM).alias("total_revenue"),
            F.sum("profit").cast(MONEY_SUM).alias("total_profit"),
            _average(F.sum("total"), F.sum("n_totals")).alias("avg_order_value"),
            F.min("first").alias("first_sale_date"),
            F.max("last").alias("last_sale_date"),
        )
    total = F.col("order_total")
    return orders.groupBy("product_id").agg(
        F.count("order_id").alias("total_orders"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum(total).cast(MONEY_SUM).alias("total_revenue"),
        F.sum("order_profit").cast(MONEY_SUM).alias("total_profit"),
        _average(F.sum(total), F.count(total)).alias("avg_order_value"),
        F.min("order_date").alias("first_sale_date"),
        F.max("order_date").alias("last_sale_date"),
    )
