from orderloom.plans.dimensions import dim_customers, dim_products
from orderloom.plans.orders import fct_orders, int_orders_enriched, priced_orders
from orderloom.plans.staging import stg_customers, stg_orders, stg_products

__all__ = [
    "dim_customers",
    "dim_products",
    "fct_orders",
    "int_orders_enriched",
    "priced_orders",
    "stg_customers",
    "stg_orders",
    "stg_products",
]
