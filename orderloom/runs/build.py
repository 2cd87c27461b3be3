"""Build the models of all layers, and test them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from orderloom import plans
from orderloom.operators.quality import run_suite
from orderloom.plans.checks import DECLARED
from orderloom.runs.ingest import IngestRun, RunReport
from orderloom.session import together
from orderloom.sinks import Warehouse


def build_models(
    warehouse: Warehouse,
    as_of: date | str | None = None,
    materialize: bool = True,
    fact_partitions: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Rebuild all models from the raw tables; returns them by ``layer.table``.

    Staging and intermediate models feed several others, so they are written once. With
    ``materialize=False`` they are views that every mart computes again. ``fact_partitions`` lays
    out the order fact by columns such as ``order_year`` and ``order_month``.
    """

    def publish(df: DataFrame, name: str, layer: str) -> DataFrame:
        if materialize:
            return warehouse.publish(df, name, layer)
        return warehouse.publish_view(df, f"{warehouse.prefix}{name}")

    raw = {name: warehouse.table(name) for name in ("customers", "products", "orders")}
    customers, products, orders = together(
        warehouse.spark,
        lambda: publish(plans.stg_customers(raw["customers"]), "stg_customers", "staging"),
        lambda: publish(plans.stg_products(raw["products"]), "stg_products", "staging"),
        lambda: publish(plans.stg_orders(raw["orders"]), "stg_orders", "staging"),
    )
    enriched = publish(
        plans.int_orders_enriched(orders, customers, products),
        "int_orders_enriched",
        "intermediate",
    )
    facts = plans.fct_orders(enriched)
    customer_dim = plans.dim_customers(customers, enriched, as_of)
    product_dim = plans.dim_products(products, enriched)
    fct_orders, dim_customers, dim_products = together(
        warehouse.spark,
        lambda: warehouse.publish(facts, "fct_orders", "marts", fact_partitions),
        lambda: warehouse.publish(customer_dim, "dim_customers", "marts"),
        lambda: warehouse.publish(product_dim, "dim_products", "marts"),
    )
    return {
        **{f"raw.{name}": df for name, df in raw.items()},
        "staging.stg_customers": customers,
        "staging.stg_products": products,
        "staging.stg_orders": orders,
        "intermediate.int_orders_enriched": enriched,
        "marts.fct_orders": fct_orders,
        "marts.dim_customers": dim_customers,
        "marts.dim_products": dim_products,
    }


@dataclass
class FullRun:
    ingestion: RunReport
    failed_tests: list[dict]

    @property
    def succeeded(self) -> bool:
        return not self.ingestion.failed and not self.failed_tests


def run_all(
    warehouse: Warehouse,
    data_dir: str,
    as_of: date | str | None = None,
    fact_partitions: tuple[str, ...] = (),
) -> FullRun:
    """Ingest, build, test. A failed ingestion ends the run; failed tests are returned."""
    warehouse.create()
    report = IngestRun(warehouse, data_dir).run()
    if report.failed:
        return FullRun(report, [])
    tables = build_models(warehouse, as_of, fact_partitions=fact_partitions)
    # One row per declared test, so what reaches the driver does not grow with the data.
    results = run_suite(tables, DECLARED).where("status = 'fail'").collect()
    return FullRun(report, [row.asDict() for row in results])
