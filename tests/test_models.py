from __future__ import annotations

import random
from datetime import date, datetime
from decimal import Decimal

import pytest

from orderloom import plans
from orderloom.operators.latest import latest_per_key
from orderloom.operators.metrics import customer_metrics, product_metrics
from orderloom.sinks.warehouse import RAW_TABLES
from tests.conftest import rows

D = Decimal
T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def raw(spark, table, data):
    return spark.createDataFrame(data, RAW_TABLES[table])


def customer(key, loaded=T1, first="Ann", last="Lee", email="a@b.de", country="DE", src="s"):
    return (key, first, last, email, country, T1, loaded, src)


def product(key, price, cost, loaded=T1, name="Lamp", category="Home"):
    return (key, name, category, D(price), D(cost), loaded, "s")


def order(key, who, what, quantity, when, status="completed", loaded=T1):
    return (key, who, what, quantity, when, status, loaded, "s")


@pytest.fixture
def staged(spark):
    customers = raw(spark, "customers", [customer(k) for k in ("C1", "C2", "C3")])
    products = raw(
        spark, "products",
        [product("P1", "149.99", "75.00"), product("P2", "24.99", "12.50", category="Food"),
         product("P3", "50.00", "20.00")],
    )
    orders = raw(
        spark, "orders",
        [order("O1", "C1", "P1", 2, datetime(2024, 1, 5, 10, 30)),
         order("O2", "C1", "P2", 1, datetime(2024, 1, 7), "shipped"),
         order("O3", "C2", "P2", 6, datetime(2024, 3, 1)),
         order("O4", "C9", "P1", 1, datetime(2024, 3, 2)),
         order("O5", "C2", "P9", 3, datetime(2024, 3, 3), "pending"),
         order("O6", None, None, 1, None, None)],
    )
    return plans.stg_customers(customers), plans.stg_products(products), plans.stg_orders(orders)


def test_latest_row_and_null_load_time_first(spark):
    data = [customer("C1", T1), customer("C1", T2, first="New"), customer("C2", T2),
            customer("C2", None, first="Null"), customer(None, T1), customer(None, T2)]
    got = latest_per_key(raw(spark, "customers", data), ["customer_id"])
    assert got.columns == list(raw(spark, "customers", data).columns)
    firsts = {r.customer_id: (r.first_name, r._loaded_at) for r in got.collect()}
    assert firsts == {"C1": ("New", T2), "C2": ("Null", None), None: ("Ann", T2)}


def test_ties_do_not_depend_on_the_spread_of_rows(spark):
    data = [customer(f"C{i % 7}", T1, first=f"F{i}", email=None if i % 3 else f"{i}@b.de")
            for i in range(200)]
    expected = None
    for seed in range(4):
        random.Random(seed).shuffle(data)
        df = raw(spark, "customers", data).repartition(1 + 3 * seed)
        got = rows(latest_per_key(df, ["customer_id"]))
        assert len(got) == 7
        assert expected in (None, got)
        expected = got


def test_latest_against_brute_force(spark):
    generator = random.Random(5)
    data = [
        order(f"O{generator.randrange(40)}", generator.choice(["C1", "C2", None]), "P1",
              generator.randrange(5), generator.choice([T1, T2]), "x",
              generator.choice([T1, T2, None]))
        for _ in range(500)
    ]

    def rank(row):
        # load time null first, then the remaining columns with null lowest
        rest = [(v is not None, v) for v in (*row[1:6], row[7])]
        return (row[6] is None, (row[6] is not None, row[6] or T1), rest)

    best = {}
    for row in data:
        if row[0] not in best or rank(row) > rank(best[row[0]]):
            best[row[0]] = row
    got = latest_per_key(raw(spark, "orders", data).repartition(9), ["order_id"])
    assert rows(got) == sorted(best.values(), key=repr)


def test_staging_cleans(spark):
    data = [customer("C1", first=" Ann ", last="Lee  ", email=" A@B.DE ", country=" DE"),
            customer("C2", last=None)]
    got = {r.customer_id: r for r in plans.stg_customers(raw(spark, "customers", data)).collect()}
    assert got["C1"].full_name == "Ann Lee" and got["C1"].email == "a@b.de"
    assert got["C1"].country == "DE" and got["C1"].customer_created_at == T1
    assert got["C2"].full_name is None
    products = raw(spark, "products", [product("P1", "24.99", "12.50"), product("P2", "0", "1")])
    got = {r.product_id: r for r in plans.stg_products(products).collect()}
    assert (got["P1"].profit_margin_pct, got["P1"].profit_per_unit) == (D("49.98"), D("12.49"))
    assert (got["P2"].profit_margin_pct, got["P2"].profit_per_unit) == (None, D("-1.00"))
    orders = raw(spark, "orders", [order("O1", "C", "P", 1, datetime(2024, 1, 7), " Shipped ")])
    row = plans.stg_orders(orders).first()
    assert row.status == "shipped" and row.order_date_day == date(2024, 1, 7)
    assert (row.order_year, row.order_month, row.order_day_of_week) == (2024, 1, 0)


def test_enriched_keeps_orders_without_match(spark, staged):
    customers, products, orders = staged
    got = {r.order_id: r for r in plans.int_orders_enriched(orders, customers, products).collect()}
    assert len(got) == 6
    assert got["O1"].order_total == D("299.98") and got["O1"].order_profit == D("149.98")
    assert got["O4"].customer_name is None and got["O4"].order_total == D("149.99")
    assert got["O5"].product_name is None and got["O5"].order_total is None
    assert got["O6"].customer_id is None


def test_facts(spark, staged):
    customers, products, orders = staged
    facts = plans.fct_orders(plans.int_orders_enriched(orders, customers, products))
    got = {r.order_id: (r.is_completed, r.order_value_tier) for r in facts.collect()}
    assert got == {
        "O1": (True, "Medium"), "O2": (False, "Low"), "O3": (True, "Medium"),
        "O4": (True, "Medium"), "O5": (False, "Low"), "O6": (False, "Low"),
    }
    assert len(facts.columns) == 22


def test_dim_customers(spark, staged):
    customers, products, orders = staged
    for lines in (plans.priced_orders(orders, products),
                  plans.int_orders_enriched(orders, customers, products)):
        dim = plans.dim_customers(customers, lines, date(2024, 4, 30))
        got = {r.customer_id: r for r in dim.collect()}
        assert set(got) == {"C1", "C2", "C3"}
        c1, c2, c3 = got["C1"], got["C2"], got["C3"]
        assert (c1.total_orders, c1.completed_orders, c1.total_items_purchased) == (2, 1, 3)
        assert c1.lifetime_value == D("324.97") and c1.order_completion_rate == D("50.00")
        assert c1.avg_order_value == D("162.485") and c1.unique_categories_purchased == 2
        assert (c1.customer_segment, c1.activity_status) == ("Gold", "At Risk")
        # The average is over orders with a total.
        assert c2.total_orders == 2 and c2.avg_order_value == D("149.94")
        assert c2.last_order_date == datetime(2024, 3, 3) and c2.activity_status == "Active"
        assert (c3.total_orders, c3.lifetime_value, c3.order_completion_rate) == (0, 0, 0)
        assert c3.first_order_date is None
        assert (c3.customer_segment, c3.activity_status) == ("Bronze", "Never Purchased")
        assert len(dim.columns) == 19


def test_dim_products(spark, staged):
    _, products, orders = staged
    dim = plans.dim_products(products, plans.priced_orders(orders, products))
    got = {r.product_id: r for r in dim.collect()}
    assert set(got) == {"P1", "P2", "P3"}
    assert got["P1"].unique_customers == 2 and got["P1"].total_revenue == D("449.97")
    assert got["P2"].total_quantity_sold == 7 and got["P2"].sales_tier == "Good Performer"
    assert got["P3"].sales_tier == "No Sales" and got["P3"].price_segment == "Economy"
    assert got["P3"].avg_order_value == 0 and len(dim.columns) == 17


def test_activity_date_defaults_to_today(spark, staged):
    customers, products, orders = staged
    dim = plans.dim_customers(customers, plans.priced_orders(orders, products))
    assert {r.activity_status for r in dim.collect()} == {"Churned", "Never Purchased"}


def test_repeated_order_ids_are_counted_once(spark, staged):
    _, products, orders = staged
    lines = plans.priced_orders(orders, products)
    doubled = lines.unionAll(lines)
    got = {r.customer_id: r for r in customer_metrics(doubled).collect()}
    assert (got["C1"].total_orders, got["C1"].completed_orders) == (2, 1)
    assert got["C1"].total_items_purchased == 6
    assert {r.product_id: r.total_orders for r in product_metrics(doubled).collect()} == {
        "P1": 2, "P2": 2, "P9": 1, None: 1,
    }


def test_unique_orders_give_the_same_metrics(spark, staged):
    _, products, orders = staged
    lines = plans.priced_orders(orders, products)
    assert rows(customer_metrics(lines)) == rows(customer_metrics(lines, orders_unique=True))
    assert rows(product_metrics(lines)) == rows(product_metrics(lines, orders_unique=True))


def test_lifetime_values_add_up_to_order_totals(spark, staged):
    customers, products, orders = staged
    facts = plans.fct_orders(plans.int_orders_enriched(orders, customers, products))
    dim = plans.dim_customers(customers, plans.priced_orders(orders, products))
    known = facts.where("customer_name is not null").agg({"order_total": "sum"}).first()[0]
    assert dim.agg({"lifetime_value": "sum"}).first()[0] == known
