"""What several operators share: fixed characters, stored steps, and settings of the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.session import materialize

# White space, and words as the longest runs of anything else.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: Runs of white space other than one plain space: the only ones that normalising changes.
UNEVEN_SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table in the shared folder."""
    return materialize(df, f"llm-{label}")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """How many words a text has: the starts of words, each a non-space after a space or the start."""
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def draw(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the columns, the same in any engine with MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def private_row(df: DataFrame, **columns: Column) -> DataFrame:
    """The named columns beside one struct ``row`` of all of the frame's own, which so cannot clash."""
    return df.select(
        *(c.alias(name) for name, c in columns.items()),
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
    )


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or a longer one that no column of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
