from __future__ import annotations

from collections import Counter
from decimal import Decimal

import pytest

from orderloom.operators import quality as q
from orderloom.plans.checks import DECLARED
from tests.conftest import rows


@pytest.fixture
def tables(spark):
    parent = spark.createDataFrame([("a",), ("b",)], "id string")
    child = spark.createDataFrame(
        [(1, "a", "ok", 5), (2, "b", "ok", -1), (2, "z", "odd", 0), (3, "z", "odd", None),
         (None, None, None, 7), (None, "y", "bad", 7)],
        "n int, parent string, status string, total int",
    )
    return {"parent": parent, "child": child}


def test_not_null(tables):
    assert q.not_null_failures(tables["child"], "n").count() == 2
    assert q.not_null_failures(tables["parent"], "id").count() == 0


def test_unique_ignores_nulls(tables):
    assert rows(q.unique_failures(tables["child"], "n")) == [(2, 2)]
    assert rows(q.unique_failures(tables["parent"], "id")) == []


def test_relationships_ignore_nulls(tables):
    got = q.relationship_failures(tables["child"], "parent", tables["parent"], "id")
    assert rows(got) == [("y", 1), ("z", 2)]
    assert rows(q.relationship_failures(tables["parent"], "id", tables["parent"], "id")) == []


def test_accepted_values_let_null_pass(tables):
    got = q.accepted_value_failures(tables["child"], "status", ["ok"])
    assert rows(got) == [("bad", 1), ("odd", 2)]
    assert rows(q.accepted_value_failures(tables["child"], "status", ["ok", "odd", "bad"])) == []


def test_suite_counts_failures(tables):
    checks = [
        q.NotNull("child", "n"),
        q.NotNull("child", "total"),
        q.NotNull("parent", "id"),
        q.Unique("child", "n"),
        q.Unique("parent", "id"),
        q.Relationship("child", "parent", "parent", "id"),
        q.AcceptedValues("child", "status", ("ok",)),
        q.AcceptedValues("child", "status", ("ok", "odd", "bad")),
        q.RowRule("positive", "child", "total", "total <= 0"),
    ]
    got = q.run_suite(tables, checks)
    assert got.columns == ["test", "table", "column", "failures", "status"]
    assert rows(got) == sorted(
        [
            ("not_null", "child", "n", 2, "fail"),
            ("not_null", "child", "total", 1, "fail"),
            ("not_null", "parent", "id", 0, "pass"),
            ("unique", "child", "n", 1, "fail"),
            ("unique", "parent", "id", 0, "pass"),
            ("relationships", "child", "parent", 3, "fail"),
            ("accepted_values", "child", "status", 2, "fail"),
            ("accepted_values", "child", "status", 0, "pass"),
            ("positive", "child", "total", 2, "fail"),
        ],
        key=repr,
    )


def test_suite_over_empty_tables(tables):
    empty = {name: df.where("false") for name, df in tables.items()}
    checks = [
        q.NotNull("child", "n"),
        q.Unique("child", "n"),
        q.Relationship("child", "parent", "parent", "id"),
        q.AcceptedValues("child", "status", ("ok",)),
    ]
    assert {(r.failures, r.status) for r in q.run_suite(empty, checks).collect()} == {(0, "pass")}


def test_declared_tests():
    kinds = Counter(type(check).__name__ for check in DECLARED)
    assert kinds == {
        "NotNull": 24, "Unique": 8, "Relationship": 2, "AcceptedValues": 2, "RowRule": 2,
    }
    by_table = Counter(check.table.split(".")[0] for check in DECLARED)
    assert by_table == {"raw": 7, "staging": 15, "intermediate": 5, "marts": 11}


@pytest.mark.parametrize(
    "name, table, value, fails",
    [
        ("ltv_non_negative", "marts.dim_customers", "-0.01", 1),
        ("ltv_non_negative", "marts.dim_customers", "0", 0),
        ("order_totals_positive", "marts.fct_orders", "0", 1),
        ("order_totals_positive", "marts.fct_orders", "0.01", 0),
        ("order_totals_positive", "marts.fct_orders", None, 0),
    ],
)
def test_row_rules(spark, name, table, value, fails):
    check = next(c for c in DECLARED if isinstance(c, q.RowRule) and c.name == name)
    amount = None if value is None else Decimal(value)
    df = spark.createDataFrame([(amount,)], f"{check.column} decimal(18,2)")
    assert q.run_suite({table: df}, [check]).first()["failures"] == fails
