"""Insert-or-update of a table by key, as joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number of a change with a null in its key: such a change is a group of its own.
LOOSE = "_loose"
#: What a merged row is: a row of the target that a change met, a new key, or anything else.
KIND, MET, NEW, OTHER = "_kind", 1, 2, 0


def reduce_changes(
    changes: DataFrame, columns: Sequence[str], keys: Sequence[str], updates: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """One row per key: its last change's update columns, its first change's other columns, its number of changes.

    A key with a null matches nothing, not even another one, so each such change stays a row.
    """
    fixed = [c for c in columns if c not in keys and c not in updates]
    loose = F.when(~_complete(keys), F.monotonically_increasing_id())
    return (
        changes.withColumn(LOOSE, loose)
        .groupBy(*keys, LOOSE)
        .agg(
            F.max(_versioned(order_by, updates)).alias("_last"),
            F.min(_versioned(order_by, fixed)).alias("_first"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select(*keys, LOOSE, F.col("_last.row").alias("_last"), F.col("_first.row").alias("_first"), "_n")
    )


def found_keys(target: DataFrame, reduced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the changes that the target has. Only its key columns are read, and it stays in place, too."""
    return target.select(*keys).join(reduced.select(*keys), list(keys), "left_semi")


def inserted(
    column: str, target: DataFrame, columns: Sequence[str], keys: Sequence[str], updates: Sequence[str], defaults: Mapping[str, Column]
) -> Column:
    """A column of the row that a reduced change inserts."""
    if column in keys:
        return F.col(f"`{column}`")
    if column in updates:
        return F.col(f"_last.`{column}`").alias(column)
    if column in columns:
        return F.col(f"_first.`{column}`").alias(column)
    return defaults.get(column, F.lit(None)).cast(target.schema[column].dataType).alias(column)


def merge_rows(
    target: DataFrame,
    reduced: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    updates: Sequence[str],
    defaults: Mapping[str, Column],
) -> DataFrame:
    """The whole target after the changes, with the kind of each row.

    ``reduced`` is a written table of reduced changes. A known key takes the update columns from its last change, a new
    key takes them from its last and all other columns from its first change.

    The target is joined from the left, so it stays in place when the changes are small enough to
    broadcast, and is shuffled once otherwise; a full outer join would always shuffle it.
    """
    by_key, loose = reduced.where(f"{LOOSE} is null"), reduced.where(f"{LOOSE} is not null")
    met = F.col("_n").isNotNull()

    def updated(name: str) -> Column:
        if name not in updates:
            return F.col(f"`{name}`")
        return F.when(met, F.col(f"_last.`{name}`")).otherwise(F.col(f"`{name}`")).alias(name)

    new_row = [inserted(c, target, columns, keys, updates, defaults) for c in target.columns]
    known = target.where(_complete(keys)).join(by_key.drop(LOOSE, "_first"), list(keys), "left")
    kept = known.select(*(updated(c) for c in target.columns), F.when(met, MET).otherwise(OTHER).alias(KIND))
    # Rows with a null in the key stay out of the joins, which would gather them in one task.
    untouched = target.where(~_complete(keys)).withColumn(KIND, F.lit(OTHER))
    new = by_key.join(found_keys(target, by_key, keys), list(keys), "left_anti").select(*new_row, F.lit(NEW).alias(KIND))
    return kept.unionAll(untouched).unionAll(new).unionAll(loose.select(*new_row, F.lit(OTHER).alias(KIND)))


def _complete(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"`{k}`").isNotNull() for k in keys))


def _versioned(order_by: Sequence[str], columns: Sequence[str]) -> Column:
    """Struct that compares by the order columns first; the payload decides only ties."""
    order = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order_by)]
    # A struct needs a field, also where there is no column to carry.
    row = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in columns))
    return F.struct(*order, row.alias("row"))
