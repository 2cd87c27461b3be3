"""Data tests: each returns the failing rows, and a suite counts them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null_failures(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique_failures(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number of rows; nulls are not compared."""
    return _value_counts(df, column).where("n_records > 1")


def relationship_failures(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values without a parent row, with their number of child rows; nulls are not looked up.

    Child values are counted before the join, so a frequent value is one row there.
    """
    keys = parent.select(F.col(key).alias(column)).distinct()
    return _value_counts(child, column).join(keys, column, "left_anti")


def accepted_value_failures(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the accepted ones, with their number of rows; null passes."""
    return _value_counts(df.where(~F.col(column).isin(*values)), column)


def _value_counts(df: DataFrame, column: str) -> DataFrame:
    present = df.where(F.col(column).isNotNull())
    return present.groupBy(column).agg(F.count(F.lit(1)).alias("n_records"))


@dataclass(frozen=True)
class NotNull:
    table: str
    column: str


@dataclass(frozen=True)
class Unique:
    table: str
    column: str


@dataclass(frozen=True)
class Relationship:
    table: str
    column: str
    parent: str
    key: str


@dataclass(frozen=True)
class AcceptedValues:
    table: str
    column: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class RowRule:
    """Rows for which ``fails`` is true are failures; null is not."""

    name: str
    table: str
    column: str
    fails: str


Check = NotNull | Unique | Relationship | AcceptedValues | RowRule


def run_suite(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """One row per check: test, table, column, failures, status.

    Every table is scanned at most twice: once for all checks that look at single rows, once for all
    checks that compare values. The result is one lazy frame, so the checks run as one job.
    """
    single = [(n, c) for n, c in enumerate(checks) if isinstance(c, (NotNull, AcceptedValues, RowRule))]
    compared = [(n, c) for n, c in enumerate(checks) if isinstance(c, (Unique, Relationship))]
    counted = [_single_rows(tables[t], own) for t, own in _by_table(single).items()]
    if compared:
        counted.append(_compared_values(tables, compared))
    names = [F.struct(F.lit(n).alias("check"), *_names(c)) for n, c in enumerate(checks)]
    spark = next(iter(tables.values())).sparkSession
    lines = spark.range(1).select(F.inline(F.array(*names)))
    # One row per check on both sides.
    found = lines.join(F.broadcast(reduce(DataFrame.unionAll, counted)), "check", "left")
    failures = F.coalesce("failures", F.lit(0))
    status = F.when(failures == 0, "pass").otherwise("fail")
    return found.select("test", "table", "column", failures.alias("failures"), status.alias("status"))


def _by_table(checks: Sequence[tuple[int, Check]]) -> dict[str, list[tuple[int, Check]]]:
    out: dict[str, list[tuple[int, Check]]] = {}
    for n, check in checks:
        out.setdefault(check.table, []).append((n, check))
    return out


def _names(check: Check) -> list[Column]:
    test = {NotNull: "not_null", Unique: "unique", Relationship: "relationships", AcceptedValues: "accepted_values"}
    name = check.name if isinstance(check, RowRule) else test[type(check)]
    return [F.lit(name).alias("test"), F.lit(check.table).alias("table"), F.lit(check.column).alias("column")]


def _single_rows(df: DataFrame, checks: Sequence[tuple[int, Check]]) -> DataFrame:
    """(check, failures) of the checks of one table that look at single rows, in one pass.

    Of accepted values the different ones that are not accepted are counted, elsewhere the rows.
    """

    def failures(check: Check) -> Column:
        column = F.col(f"`{check.column}`")
        if isinstance(check, NotNull):
            return F.count_if(column.isNull())
        if isinstance(check, AcceptedValues):
            return F.count_distinct(F.when(~column.isin(*check.values), column))
        return F.count_if(F.expr(check.fails))

    lines = [F.struct(F.lit(n).alias("check"), failures(c).alias("failures")) for n, c in checks]
    return df.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def _compared_values(tables: Mapping[str, DataFrame], checks: Sequence[tuple[int, Check]]) -> DataFrame:
    """(check, failures) of uniqueness and relationships, from one count of all their values.

    A row gives a value for each check that it takes part in, as child or as parent; the values are
    counted before and after one shuffle, so a frequent value is one row for each task.
    """
    roles: dict[str, list[Column]] = {}

    def role(table: str, column: str, n: int, parent: bool) -> None:
        value = F.col(f"`{column}`").cast("string")
        fields = (F.lit(n).alias("check"), F.lit(parent).alias("parent"), value.alias("value"))
        roles.setdefault(table, []).append(F.struct(*fields))

    for n, check in checks:
        role(check.table, check.column, n, False)
        if isinstance(check, Relationship):
            role(check.parent, check.key, n, True)
    values = [tables[t].select(F.inline(F.array(*own))).where("value is not null") for t, own in roles.items()]
    counts = reduce(DataFrame.unionAll, values).groupBy("check", "value").agg(
        F.count_if(~F.col("parent")).alias("n"), F.count_if("parent").alias("n_parents")
    )
    unique = F.col("check").isin(*(n for n, c in checks if isinstance(c, Unique)))
    repeated = F.when(F.col("n") > 1, 1).otherwise(0)
    orphans = F.when(F.col("n_parents") == 0, F.col("n")).otherwise(0)
    return counts.groupBy("check").agg(F.sum(F.when(unique, repeated).otherwise(orphans)).alias("failures"))
