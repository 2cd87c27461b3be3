"""Small tables with the cases that every operator must take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
#: id, text, source: null and empty texts, a very long one, ties, repeated rows, a null id and source.
ODD = [
    (5, None, "b"),
    (6, "", "b"),
    (7, LONG, "a"),
    (8, "one  two\tthree four five six seven", "a"),
    (9, "one two three four five six seven", "a"),
    (9, "one two three four five six seven", "a"),
    (None, "one two three four five six seven", None),
    (3, " \n ", None),
]
SCHEMA = "doc_id long, text string, source string"
#: Columns with names that an operator might use itself.
CLASHING = ("row", "id", "key", "n", "score", "leaks", "findings", "gone", "h", "sha", "kept", "component_id", "node")


def docs(spark: SparkSession, rows=ODD, clashing: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        for name in CLASHING:
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def sample(spark: SparkSession, name: str, sf: str = "sf0.001") -> DataFrame:
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
