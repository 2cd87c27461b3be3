from orderloom.functions.labels import (
    activity_status,
    customer_segment,
    order_value_tier,
    price_segment,
    sales_tier,
)
from orderloom.functions.scalars import (
    calculate_margin,
    date_parts,
    date_spine,
    margin_pct,
    safe_divide,
    spine,
)

__all__ = [
    "activity_status",
    "calculate_margin",
    "customer_segment",
    "date_parts",
    "date_spine",
    "margin_pct",
    "order_value_tier",
    "price_segment",
    "safe_divide",
    "sales_tier",
    "spine",
]
