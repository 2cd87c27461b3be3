from __future__ import annotations

import json
import random
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

import pytest
from pyspark.sql import functions as F

from orderloom.operators.records import RECORDS, Field, Kind, Record
from orderloom.operators.validation import (
    SchemaValidator,
    check_field,
    rule_counts,
    with_parsed,
)

CUSTOMER = dict(
    customer_id="C1", first_name="Ann", last_name="Lee", email="Ann.Lee@Mail.com", country="DE",
    created_at="2024-01-01 08:00:00",
)
PRODUCT = dict(
    product_id="P1", product_name="Lamp", category="Home", price="99.99", cost="50"
)
ORDER = dict(
    order_id="O1", customer_id="C1", product_id="P1", quantity="2",
    order_date="2024-01-05 10:30:00", status="completed",
)
GOOD = {"customers": CUSTOMER, "products": PRODUCT, "orders": ORDER}


def frame(spark, records):
    names = list(records[0])
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in records], schema)


def broken(spark, schema, **changes):
    """Rules a good record breaks after some changes."""
    df = frame(spark, [{**GOOD[schema], **changes}])
    valid, rejects = SchemaValidator("filter").validate(df, schema)
    found = [(e.field, e.rule) for r in rejects.collect() for e in r["_errors"]]
    assert (valid.count() == 0) == bool(found)
    return found


@pytest.mark.parametrize("schema", GOOD)
def test_good_record_passes_strict(spark, schema):
    valid, rejects = SchemaValidator("strict").validate(frame(spark, [GOOD[schema]]), schema)
    assert valid.count() == 1 and rejects.count() == 0


CASES = [
    ("customers", dict(customer_id=None), "required"),
    ("customers", dict(customer_id=""), "min_length"),
    ("customers", dict(first_name="  "), None),
    ("customers", dict(last_name=""), "min_length"),
    ("customers", dict(country="D"), "min_length"),
    ("customers", dict(country="日本"), None),
    ("customers", dict(email=None), "required"),
    ("customers", dict(email="invalid-email"), "pattern"),
    ("customers", dict(email="a@b.co"), None),
    ("customers", dict(email="jürgen@büro.de"), None),
    ("customers", dict(email=" a@b.co"), "pattern"),
    ("customers", dict(email="a@b.co "), "pattern"),
    ("customers", dict(email="a@b.co\n"), "pattern"),
    ("customers", dict(email="a+b@c.de"), "pattern"),
    ("customers", dict(email="a@b@c.de"), "pattern"),
    ("customers", dict(email="a@b"), "pattern"),
    ("customers", dict(created_at=None), None),
    ("customers", dict(created_at="yesterday"), "datetime"),
    ("customers", dict(created_at="2024-02-30"), "datetime"),
    ("products", dict(price="0"), "greater_than"),
    ("products", dict(price="-10"), "greater_than"),
    ("products", dict(price="0.004"), None),
    ("products", dict(price="1e-19"), None),
    ("products", dict(price="-1e-19"), "greater_than"),
    ("products", dict(price="1e3"), None),
    ("products", dict(price=" 12.5 "), None),
    ("products", dict(price="abc"), "number"),
    ("products", dict(price="12d"), "number"),
    ("products", dict(price=None), "required"),
    ("products", dict(price="Infinity"), "finite"),
    ("products", dict(price="-Infinity"), "greater_than"),
    ("products", dict(price="123456789012"), "finite"),
    ("products", dict(price="1e40"), "finite"),
    ("products", dict(cost="0"), None),
    ("products", dict(cost="-0.01"), "at_least"),
    ("products", dict(category=""), "min_length"),
    ("orders", dict(quantity="2.0"), None),
    ("orders", dict(quantity="2.5"), "integer"),
    ("orders", dict(quantity="0"), "greater_than"),
    ("orders", dict(quantity="-1"), "greater_than"),
    ("orders", dict(quantity="two"), "number"),
    ("orders", dict(quantity="3000000000"), "integer"),
    ("orders", dict(status="invalid_status"), "one_of"),
    ("orders", dict(status="Completed"), "one_of"),
    ("orders", dict(status="completed "), "one_of"),
    ("orders", dict(order_date="n.d."), "datetime"),
    ("orders", dict(order_date=None), None),
]


@pytest.mark.parametrize("schema, changes, rule", CASES)
def test_rules(spark, schema, changes, rule):
    expected = [] if rule is None else [(next(iter(changes)), rule)]
    assert broken(spark, schema, **changes) == expected


def test_all_broken_rules_of_a_row_are_reported(spark):
    found = broken(spark, "orders", quantity="0", status="x", customer_id=None)
    assert found == [
        ("customer_id", "required"), ("quantity", "greater_than"), ("status", "one_of"),
    ]


def test_values_are_normalised_and_typed(spark):
    customers, _ = SchemaValidator().validate(frame(spark, [CUSTOMER]), "customers")
    row = customers.first()
    assert row["email"] == "ann.lee@mail.com" and row["created_at"] == datetime(2024, 1, 1, 8)
    products = frame(spark, [{**PRODUCT, "price": "2.675", "cost": "0.125"}])
    row = SchemaValidator().validate(products, "products")[0].first()
    assert (row["price"], row["cost"]) == (Decimal("2.68"), Decimal("0.13"))
    orders, _ = SchemaValidator().validate(frame(spark, [{**ORDER, "quantity": "2.0"}]), "orders")
    assert orders.first()["quantity"] == 2
    assert dict(orders.dtypes)["quantity"] == "int"


def test_typed_input(spark):
    df = spark.createDataFrame(
        [("P1", "a", "b", 10.005, 1), ("P2", "a", "b", float("nan"), 1),
         ("P3", "a", "b", float("inf"), 1), ("P4", "a", "b", -1.0, -1)],
        "product_id string, product_name string, category string, price double, cost int",
    )
    valid, rejects = SchemaValidator().validate(df, "products")
    assert [(r.product_id, r.price, r.cost) for r in valid.collect()] == [
        ("P1", Decimal("10.01"), Decimal("1.00"))
    ]
    found = [[(e.field, e.rule) for e in r["_errors"]] for r in rejects.orderBy("_row_id").collect()]
    assert found == [
        [("price", "required")], [("price", "finite")],
        [("price", "greater_than"), ("cost", "at_least")],
    ]


def test_typed_dates_and_numbers_in_text_fields(spark):
    df = spark.createDataFrame(
        [("O1", 7, "P1", 2, date(2024, 1, 5), "pending")],
        "order_id string, customer_id int, product_id string, quantity int, order_date date, "
        "status string",
    )
    valid, rejects = SchemaValidator().validate(df, "orders")
    assert valid.count() == 0
    assert [(e.field, e.rule) for e in rejects.first()["_errors"]] == [("customer_id", "text")]
    good = df.withColumn("customer_id", F.lit("C7"))
    assert SchemaValidator().validate(good, "orders")[0].first()["order_date"] == datetime(
        2024, 1, 5
    )


def test_other_columns_stay_and_absent_optional_ones_are_added(spark):
    record = {k: v for k, v in CUSTOMER.items() if k != "created_at"}
    df = frame(spark, [{**record, "note": "n", "_source": "s"}])
    valid, _ = SchemaValidator().validate(df, "customers")
    assert valid.columns == [*record, "note", "_source", "created_at"]
    assert valid.first()["created_at"] is None
    assert dict(valid.dtypes)["created_at"] == "timestamp_ntz"


def test_absent_required_column_rejects_every_row(spark):
    df = frame(spark, [CUSTOMER, CUSTOMER]).drop("email")
    valid, rejects = SchemaValidator().validate(df, "customers")
    assert valid.count() == 0
    assert [[(e.field, e.rule) for e in r["_errors"]] for r in rejects.collect()] == [
        [("email", "missing")]
    ] * 2


def test_filter_keeps_valid_rows_and_reports_the_rest(spark):
    df = frame(spark, [CUSTOMER, {**CUSTOMER, "customer_id": "C2", "email": "bad"}])
    valid, rejects = SchemaValidator("filter").validate(df, "customers")
    assert [r.customer_id for r in valid.collect()] == ["C1"]
    report = rejects.collect()
    assert len(report) == 1
    assert json.loads(report[0]["_data"])["email"] == "bad"
    assert json.loads(report[0]["_data"])["customer_id"] == "C2"
    assert report[0]["_errors"][0].value == "bad"


def test_report_keeps_null_values(spark):
    _, rejects = SchemaValidator().validate(frame(spark, [{**ORDER, "status": None}]), "orders")
    assert json.loads(rejects.first()["_data"])["status"] is None


def test_flag_keeps_all_rows_with_original_values(spark):
    bad = {**PRODUCT, "product_id": "P2", "price": "-5.555"}
    valid = {**PRODUCT, "price": "10.999"}
    df, rejects = SchemaValidator("flag").validate(frame(spark, [valid, bad]), "products")
    got = {r.product_id: r for r in df.collect()}
    assert got["P1"]["_is_valid"] is True and got["P1"]["_validation_errors"] is None
    assert got["P1"]["price"] == "11.00"
    assert got["P2"]["_is_valid"] is False and got["P2"]["price"] == "-5.555"
    assert json.loads(got["P2"]["_validation_errors"]) == [
        {"field": "price", "rule": "greater_than", "value": "-5.555"}
    ]
    assert rejects.count() == 1


def test_strict_raises_for_the_first_bad_row(spark):
    df = frame(spark, [ORDER, {**ORDER, "status": "first"}, {**ORDER, "quantity": "0"}]).coalesce(1)
    with pytest.raises(ValueError, match=r"status: one_of \(first\)"):
        SchemaValidator("strict").validate(df, "orders")


def test_unknown_mode_and_schema(spark):
    with pytest.raises(ValueError, match="loose"):
        SchemaValidator("loose")
    with pytest.raises(ValueError, match="invoices"):
        SchemaValidator().validate(frame(spark, [ORDER]), "invoices")
    with pytest.raises(ValueError, match="invoices"):
        SchemaValidator().get_schema_columns("invoices")


def test_schema_columns():
    assert SchemaValidator().get_schema_columns("products") == list(PRODUCT)


def test_own_record(spark):
    points = Record("points", (Field("x", Kind.WHOLE, at_least=0),))
    validator = SchemaValidator(records={**RECORDS, "points": points})
    valid, _ = validator.validate(spark.createDataFrame([("1",), ("-1",)], "x string"), "points")
    assert [r.x for r in valid.collect()] == [1]


def test_unparsed_date_is_an_error_and_the_helper_goes(spark):
    df = frame(spark, [ORDER, {**ORDER, "order_id": "O2"}]).withColumns(
        {
            "_unparsed_order_date": F.when(F.col("order_id") == "O2", "soon"),
            "order_date": F.when(F.col("order_id") == "O1", F.lit("2024-01-05")).cast(
                "timestamp_ntz"
            ),
        }
    )
    valid, rejects = SchemaValidator().validate(df, "orders")
    assert valid.columns == list(ORDER) and [r.order_id for r in valid.collect()] == ["O1"]
    error = rejects.first()["_errors"][0]
    assert (error.field, error.rule, error.value) == ("order_date", "datetime", "soon")


def test_counts_come_with_the_pass_over_the_rows(spark):
    df = frame(spark, [ORDER] * 5 + [{**ORDER, "status": "x"}] * 3)
    checked = SchemaValidator().check(df, "orders")
    checked.rows.write.format("noop").mode("overwrite").save()
    assert checked.counts.get == {"valid": 5, "rejected": 3}


def test_rule_counts(spark):
    df = frame(spark, [ORDER, {**ORDER, "status": "x"}, {**ORDER, "status": "y", "quantity": "0"}])
    counts = rule_counts(SchemaValidator().validate(df, "orders")[1])
    assert sorted(tuple(r) for r in counts.collect()) == [
        ("quantity", "greater_than", 1), ("status", "one_of", 2),
    ]


def number_rules(text):
    """Price rule, rounded price, quantity rule, quantity: by exact arithmetic in plain Python."""
    try:
        number = Decimal(text.strip(" "))
    except InvalidOperation:
        return ("number", None, "number", None)
    cents = number.quantize(Decimal("0.01"), ROUND_HALF_UP)
    price_rule = "greater_than" if number <= 0 else "finite" if cents >= 10**8 else None
    whole = number == number.to_integral_value() and abs(number) < 2**31
    quantity_rule = "integer" if not whole else "greater_than" if number <= 0 else None
    return (
        price_rule,
        None if abs(cents) >= 10**8 else cents,
        quantity_rule,
        int(number) if whole else None,
    )


def test_random_numbers_against_exact_arithmetic(spark):
    generator = random.Random(3)
    texts = {
        "".join(generator.choices("0123456789", k=generator.randint(1, size)))
        .join(generator.choice([("", ""), ("-", ""), ("", ".0"), ("", ".5"), ("0.00", ""),
                                ("", "e2"), (" ", " "), ("+", ".005"), ("", "."), ("-.", ""),
                                ("", "x"), ("", "e"), ("1 ", "")]))
        for size in (1, 2, 5, 9, 12)
        for _ in range(300)
    }
    df = spark.createDataFrame([(t, t, t) for t in sorted(texts)], "t string, p string, q string")
    price = check_field(Field("p", Kind.MONEY, above=0), df.schema)
    quantity = check_field(Field("q", Kind.WHOLE, above=0), df.schema)
    got = with_parsed(df, [price, quantity]).select(
        "t",
        price.error["rule"].alias("price_rule"),
        price.value.alias("price"),
        quantity.error["rule"].alias("quantity_rule"),
        F.when(quantity.error["rule"] != "integer", quantity.value)
        .when(quantity.error.isNull(), quantity.value)
        .alias("quantity"),
    )
    for row in got.collect():
        assert tuple(row)[1:] == number_rules(row.t), row.t
