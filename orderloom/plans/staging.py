"""Staging models: latest row per key, cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import date_parts, margin_pct
from orderloom.operators.latest import latest_per_key


def stg_customers(raw_customers: DataFrame) -> DataFrame:
    return clean_customers(latest_per_key(raw_customers, ["customer_id"]))


def stg_products(raw_products: DataFrame) -> DataFrame:
    return clean_products(latest_per_key(raw_products, ["product_id"]))


def stg_orders(raw_orders: DataFrame) -> DataFrame:
    return clean_orders(latest_per_key(raw_orders, ["order_id"]))


def clean_customers(rows: DataFrame) -> DataFrame:
    first, last = F.trim("first_name"), F.trim("last_name")
    return rows.select(
        "customer_id",
        first.alias("first_name"),
        last.alias("last_name"),
        F.concat(first, F.lit(" "), last).alias("full_name"),
        F.lower(F.trim("email")).alias("email"),
        F.trim("country").alias("country"),
        F.col("created_at").alias("customer_created_at"),
        "_loaded_at",
        "_source",
    )


def clean_products(rows: DataFrame) -> DataFrame:
    price, cost = F.col("price"), F.col("cost")
    return rows.select(
        "product_id",
        F.trim("product_name").alias("product_name"),
        F.trim("category").alias("category"),
        _money(price).alias("price"),
        _money(cost).alias("cost"),
        margin_pct(price, cost).cast("decimal(18,2)").alias("profit_margin_pct"),
        F.round(price - cost, 2).cast("decimal(18,2)").alias("profit_per_unit"),
        "_loaded_at",
        "_source",
    )


def clean_orders(rows: DataFrame) -> DataFrame:
    return rows.select(
        "order_id",
        "customer_id",
        "product_id",
        "quantity",
        F.lower(F.trim("status")).alias("status"),
        "order_date",
        *(part.alias(name) for name, part in date_parts(F.col("order_date")).items()),
        "_loaded_at",
        "_source",
    )


def _money(amount: Column) -> Column:
    return F.round(amount, 2).cast("decimal(10,2)")
