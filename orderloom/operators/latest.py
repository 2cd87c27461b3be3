"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame, keys: Sequence[str], version: str = "_loaded_at"
) -> DataFrame:
    """Keep the row with the highest ``version`` of each key; a null version counts as highest.

    Ties go to the row whose remaining columns compare highest, in column order, so the result
    does not depend on how the data is spread.

    An aggregate is used, not a ranking window: each task sends at most one row per key to the
    shuffle, however many rows a key has, and the optimizer knows the result is unique by key. As the
    compared rows hold text, Spark aggregates them by sorting, before and after the shuffle; where keys hardly
    repeat, this takes about as long as a window. The compared struct is a column of its own: as part of
    the aggregate it would be put together again for each comparison.
    """
    rest = [c for c in df.columns if c not in keys and c != version]
    rank = F.struct(F.col(version).isNull().alias("_no_version"), F.col(version), *rest)
    ranked = df.select(*keys, rank.alias("_latest"))
    latest = ranked.groupBy(*keys).agg(F.max("_latest").alias("_latest"))
    return latest.select(*(c if c in keys else F.col(f"_latest.{c}") for c in df.columns))
