"""Connected components of links between integers, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import stored


def _smallest(pairs: DataFrame) -> DataFrame:
    """Of (u, v) rows: u and the smallest of u and its v. Written, so that joins may split a hot u."""
    return stored(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "smallest")


def components(links: DataFrame) -> DataFrame:
    """Of (a, b) rows: node and root (the smallest node that it reaches), for every node of a link.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every node hooks its larger
    neighbours, then its smaller ones, onto the smallest of them, until all links point at a root. The
    number of rounds grows with the logarithm of the longest chain. Each step is a table, reduced to
    distinct links; a node with many links is split by the join and pre-aggregated by the minimum.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    state = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large-star")
        smallest = _smallest(large)
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v"))
        )
        edges = stored(small.where("u <> v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
