"""Mixing sources to target weights.

Words are summed per source, the targets give each source a repetition rate, and every document is
emitted floor(rate) times, plus once more if a number drawn from the hash of its id is below the
rate's fraction.

Targets: the sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words by
weight. A target stops at ``most`` times its source's words; the excess is shared again by weight
among the others, until none is above its limit.

Defined results: a null text has no words; a null source is a source of its own; rows that repeat an
identifier get the same draw; a source without words has target 0 and its documents are not emitted;
an empty table gives an empty table; other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import draw, private_row, stored, text_of, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: No target is above this many times its source.
MOST = 3.0


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Of (source, size) rows: source, source_size, target, rate; a table with a row per source.

    The rank of a source is its place in its range of a sorted table plus the sizes of the ranges before
    it, and the limits are found by one small aggregate per round, so no task holds all sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranges = stored(
        totals.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33)),
        "sources",
    )
    # One row per partition of the sort.
    offsets = ranges.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    rank = F.col("before") + F.col("at") - F.shiftleft("part", 33)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    ranked = stored(
        ranges.join(offsets, "part").select(
            "source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit")
        ),
        "source-weights",
    )
    share = _share_per_weight(ranked)
    target = F.least("limit", F.col("weight") * share)
    return ranked.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def _share_per_weight(ranked: DataFrame) -> float:
    """Words per unit of weight for the sources below their limit, raised until no other is above it."""
    share, n_full = 0.0, -1
    while True:
        full = F.col("limit") <= F.col("weight") * share
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("limit")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == n_full or not row["weight"]:
            return share
        share, n_full = (row["all"] - row["taken"]) / row["weight"], row["n"]


def copies(rate, seed: int, identifier):
    """How often a document is emitted."""
    whole = F.floor(rate)
    return (whole + F.when(draw(seed, identifier) < rate - whole, 1).otherwise(0)).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return stored(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{source_col}`").alias("source"),
            word_count(text_of(text_col)).alias("size"),
        ),
        "sizes",
    )


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: float = MOST,
    seed: int = 17,
) -> DataFrame:
    """Per document: id, size, source_size, target (of its source), rate, copies, taken (words)."""
    sized = _sized(docs, id_col, text_col, source_col)
    targets = source_targets(sized, weights, most).withColumnRenamed("source", "of")
    n = copies(F.col("rate"), seed, F.col("id"))
    return sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        "rate",
        n.alias("copies"),
        (n * F.col("size")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: float = MOST,
    seed: int = 17,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    sized = _sized(docs, id_col, text_col, source_col)
    targets = source_targets(sized, weights, most).select(F.col("source").alias("of"), "rate")
    rows = private_row(docs, id=F.col(f"`{id_col}`"), source=F.col(f"`{source_col}`"))
    n = copies(F.col("rate"), seed, F.col("id"))
    return (
        rows.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .select("row", n.alias("n"))
        .where("n > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .select("row.*")
    )
