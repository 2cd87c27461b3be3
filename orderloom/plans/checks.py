"""The data tests declared for the tables of the warehouse."""

from __future__ import annotations

from orderloom.operators.quality import AcceptedValues, Check, NotNull, Relationship, RowRule, Unique
from orderloom.operators.records import STATUSES

# Columns that must not be null and columns that must be unique, by table.
NOT_NULL = {
    "raw.customers": ("customer_id", "email"),
    "raw.products": ("product_id", "price"),
    "raw.orders": ("order_id", "customer_id", "product_id"),
    "staging.stg_customers": ("customer_id", "email"),
    "staging.stg_products": ("product_id", "product_name", "price"),
    "staging.stg_orders": ("order_id", "customer_id", "product_id"),
    "intermediate.int_orders_enriched": ("order_id", "customer_id", "product_id", "order_total"),
    "marts.fct_orders": ("order_id", "order_total", "order_profit"),
    "marts.dim_customers": ("customer_id",),
    "marts.dim_products": ("product_id",),
}
UNIQUE = {
    "staging.stg_customers": ("customer_id", "email"),
    "staging.stg_products": ("product_id",),
    "staging.stg_orders": ("order_id",),
    "intermediate.int_orders_enriched": ("order_id",),
    "marts.fct_orders": ("order_id",),
    "marts.dim_customers": ("customer_id",),
    "marts.dim_products": ("product_id",),
}

DECLARED: tuple[Check, ...] = (
    *(NotNull(t, c) for t, columns in NOT_NULL.items() for c in columns),
    *(Unique(t, c) for t, columns in UNIQUE.items() for c in columns),
    Relationship("staging.stg_orders", "customer_id", "staging.stg_customers", "customer_id"),
    Relationship("staging.stg_orders", "product_id", "staging.stg_products", "product_id"),
    AcceptedValues("staging.stg_orders", "status", STATUSES),
    AcceptedValues(
        "marts.dim_customers", "customer_segment", ("Bronze", "Silver", "Gold", "Platinum")
    ),
    RowRule("ltv_non_negative", "marts.dim_customers", "lifetime_value", "lifetime_value < 0"),
    RowRule("order_totals_positive", "marts.fct_orders", "order_total", "order_total <= 0"),
)
