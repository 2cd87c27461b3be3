"""Exact duplicates by sorting whole contents.

The normalised texts are range-partitioned by sampled splitters and sorted, so equal texts lie next
to each other; neighbours are compared in full, and the smallest identifier of equal ones is kept.
DataFrame functions only.

Splitters are sampled from a short key (the text's first characters and a hash of the whole text), so
what the driver sees of the sample is small however long the texts are. The sort and the comparison use
the whole text. A text that has more than its share of all rows is dealt to several ranges; its
pieces, each compared in full, are put together by the SHA-256 of the text.

Defined results: a null text counts as empty; a null identifier counts as larger than any other;
rows that repeat identifier and text are one group, of which one row is kept; an empty table gives an
empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import UNEVEN_SPACES, private_row, shuffle_partitions, stored, text_of

#: Characters of a text that the splitters see, besides its hash.
SPLITTER_CHARS = 32
#: A text is dealt to several ranges from this share of an average partition's rows, and this many rows.
HOT_SHARE, HOT_ROWS = 0.25, 64


def normalised(text):
    """Every run of white space as one space."""
    return F.regexp_replace(text, UNEVEN_SPACES, " ")


def _pieces(base: DataFrame) -> DataFrame:
    """``base`` (id, body, ...) sorted by content, with what full comparison of neighbours shows.

    Adds ``sha``, ``split`` (whether the text was dealt to several ranges), and of the piece of equal
    texts in this range ``first`` (smallest id), ``n_piece`` and ``place`` (1 for the first row).
    """
    parts = shuffle_partitions(base.sparkSession)
    limit = max(HOT_ROWS, int(base.count() / parts * HOT_SHARE))
    hashed = base.withColumn("h", F.xxhash64("body"))
    # At most rows / limit = partitions / HOT_SHARE hashes are that frequent, whatever the input: two
    # numbers each, so they are small enough to broadcast.
    hot = (
        hashed.groupBy("h").agg(F.count("*").alias("n"))
        .where(F.col("n") > limit)
        .select("h", F.ceil(F.col("n") / limit).cast("int").alias("n_ranges"))
    )
    dealt = (
        hashed.join(F.broadcast(hot), "h", "left")
        .withColumn("split", F.col("n_ranges").isNotNull())
        .withColumn("range", F.when(F.col("split"), F.pmod(F.xxhash64("id"), "n_ranges")).otherwise(0))
        .withColumn("lead", F.substring("body", 1, SPLITTER_CHARS))
        .drop("n_ranges")
        .repartitionByRange("lead", "h", "range")
    )
    # The range partitioning already places what these windows need: sorting is all that is added.
    equal = Window.partitionBy("lead", "h", "range", "body")
    in_order = equal.orderBy(F.col("id").asc_nulls_last())
    return (
        dealt.withColumn("first", F.first("id").over(in_order))
        .withColumn("place", F.row_number().over(in_order))
        .withColumn("n_piece", F.count("*").over(equal))
        .withColumn("sha", F.sha2("body", 256))
        .drop("lead", "h", "range", "body")
    )


def _merged(pieces: DataFrame) -> DataFrame:
    """Smallest id and size of the texts that were dealt to several ranges: as few rows as such texts."""
    return pieces.where("split and place = 1").groupBy("sha").agg(
        F.min("first").alias("first_of_all"), F.sum("n_piece").alias("n_of_all")
    )


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(text_of(text_col)).alias("body"))
    pieces = stored(_pieces(base), "content-sort")
    joined = pieces.join(F.broadcast(_merged(pieces)), "sha", "left")
    keep = F.when(F.col("split"), F.col("first_of_all")).otherwise(F.col("first"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n_of_all", "n_piece").cast("long").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    base = private_row(
        docs, id=F.col(f"`{id_col}`"), body=normalised(text_of(text_col))
    )
    firsts = stored(_pieces(base).where("place = 1"), "content-firsts")
    joined = firsts.join(F.broadcast(_merged(firsts)), "sha", "left")
    stays = ~F.col("split") | F.col("id").eqNullSafe(F.col("first_of_all"))
    return joined.where(stays).select("row.*")
