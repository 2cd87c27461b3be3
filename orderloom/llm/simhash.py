"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint bit is set if more than half of the hashes of the text's word shingles have it set. Two
fingerprints are linked if they differ in at most ``max_distance`` bits; components of linked documents
are classes.

Links are searched among the distinct fingerprints (copies of one are one row). The fingerprint is cut
into segments; if two fingerprints differ in few bits, some segment differs in very few: each
fingerprint enumerates the Hamming ball of a small radius within each segment, fetches the
table's fingerprints that have such a segment, and the complete distance is verified.

That is complete. A segment value that more than ``most_in_bucket`` fingerprints have is not joined
pair by pair. Such fingerprints enumerate the ball of half the distance around the complete fingerprint instead: two
of them are within the distance exactly if their balls meet, so each point of a ball links the
fingerprints around it to the smallest of them. The work is linear in the fingerprints, and no link is lost.

Defined results: a null text is empty; a text without words has fingerprint zero; fewer words than a
shingle make one shingle; rows that repeat an identifier link like other copies; an empty table gives
an empty table; other columns are not read, whatever their names. Identifiers are whole numbers; a
null one is null in the result and is not the name of a class unless all of its class are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import stored, unused
from orderloom.llm.links import components
from orderloom.llm.words import in_steps

HASH_SEED = 42
#: Shingles that are counted at a time.
CHUNK = 1 << 14


@dataclass(frozen=True)
class Scheme:
    """How fingerprints are made and searched: words of a shingle, the radius of each segment, the largest distance.

    ``radii`` has one radius per segment; the segments cut the 64 bits into equal parts of at most 32 bits. The
    search is complete if max_distance is even and less than sum(radius + 1); others are refused.
    """

    shingle: int = 3
    radii: tuple[int, ...] = (1, 0)
    max_distance: int = 2
    most_in_bucket: int = 32

    def __post_init__(self) -> None:
        # Hot segments halve the distance.
        if self.max_distance >= sum(r + 1 for r in self.radii) or self.max_distance % 2:
            raise ValueError(f"balls of radii {self.radii} miss links at {self.max_distance} bits")


#: The fingerprint of a document, and links at two bits or fewer.
BITS_64 = Scheme()


def _shingle_hashes(tokens: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, some at a time."""
    n = max(1, len(tokens) - k + 1)
    for start in range(0, n, CHUNK):
        part = tokens[start : min(n, start + CHUNK) + k - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False)) if len(part) >= k else [b" ".join(part)]
        yield np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles), np.uint64)


def fingerprint(text: bytes, scheme: Scheme) -> int:
    """The 64 bits of a text's fingerprint."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    n, total = 0, np.zeros(64, np.int64)
    for hashes in _shingle_hashes(tokens, scheme.shingle):
        n += len(hashes)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, scheme: Scheme, text_col: str = "text") -> DataFrame:
    """Of (id, text) rows: id and fp, the fingerprint as a signed number."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches, "text"):
            texts = pc.fill_null(step.column(1).cast(pa.string()), "").cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), scheme) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.col(text_col).alias("text")).mapInArrow(computed, f"id {id_type}, fp bigint")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _ball(key: Column, masks: list[int]) -> Column:
    """The key with each of the masks applied."""
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: m.bitwiseXOR(key))


def _segments(scheme: Scheme) -> list[tuple[int, Column]]:
    """(radius, key) of each segment: its number above its bits."""
    width = 64 // len(scheme.radii)
    low = (1 << width) - 1
    return [
        (
            radius,
            F.shiftrightunsigned("fp", width * s).bitwiseAND(F.lit(low)).bitwiseOR(F.lit(s << 32).cast("long")),
        )
        for s, radius in enumerate(scheme.radii)
    ]


def _entries(prints: DataFrame, scheme: Scheme, *columns: str) -> DataFrame:
    """The table: a row (key, ...) for each segment of each fingerprint."""
    return prints.select(F.explode(F.array(*(key for _, key in _segments(scheme)))).alias("key"), *columns)


def _hot_buckets(prints: DataFrame, scheme: Scheme) -> DataFrame:
    """The keys of segments that too many fingerprints have."""
    counts = _entries(prints, scheme).groupBy("key").count()
    return counts.where(F.col("count") > scheme.most_in_bucket).select("key")


def _probe_links(prints: DataFrame, hot: DataFrame, scheme: Scheme) -> DataFrame:
    """Links found through segments that few fingerprints have.

    Probes and table carry a key and a node; the fingerprints join the pairs that met, to be verified.
    """
    width = 64 // len(scheme.radii)
    balls = [_ball(key, _masks(width, radius)) for radius, key in _segments(scheme)]
    probes = prints.select(F.explode(F.concat(*balls)).alias("key"), F.col("node").alias("a"))
    table = _entries(prints, scheme, "node").join(hot, "key", "left_anti").withColumnRenamed("node", "b")
    return _verified(probes.join(table, "key"), prints, scheme)


def _verified(met: DataFrame, prints: DataFrame, scheme: Scheme) -> DataFrame:
    """Of the pairs (a, b) that met, those within the distance, each once."""
    pairs = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(prints.select(F.col("node").alias(side), F.col("fp").alias(f"fp_{side}")), side)
    return pairs.where(distance(F.col("fp_a"), F.col("fp_b")) <= scheme.max_distance).select("a", "b")


def _members_of_hot(prints: DataFrame, hot: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, node, fp) of the fingerprints that have a hot segment, once for each."""
    return _entries(prints, scheme, "node", "fp").join(hot, "key")


def _ball_links(prints: DataFrame, hot: DataFrame, scheme: Scheme) -> DataFrame:
    """Links between members of hot buckets: through the points that their balls share.

    Around every fingerprint the ball of half the distance is enumerated; whatever meets in a point is
    linked to the smallest that meets there, so a point with many fingerprints gives one link for each.
    """
    members = _members_of_hot(prints, hot, scheme).select("node", "fp").distinct()
    masks = _masks(64, scheme.max_distance // 2)
    points = members.select(
        "node", F.explode(F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks))).alias("mask"), "fp"
    ).select("node", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    points = stored(points, "ball-points")
    least = stored(points.groupBy("point").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "ball-least")
    return points.join(least, "point").select(F.col("node").alias("a"), "b").where("a <> b").distinct()


def links(prints: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b) links between the nodes of distinct fingerprints (node, fp)."""
    hot = stored(_hot_buckets(prints, scheme), "hot-segments")
    found = _probe_links(prints, hot, scheme)
    return found if hot.isEmpty() else found.unionByName(_ball_links(prints, hot, scheme))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )


def _classes(prints: DataFrame, scheme: Scheme) -> DataFrame:
    # A fingerprint is named by its smallest id; one that has only null ids by none.
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("node")), "distinct-fingerprints")
    roots = components(links(nodes.where("node is not null"), scheme))
    named = nodes.join(roots, "node", "left").select(
        F.col("fp").alias("of"), F.coalesce("root", "node").alias("component_id")
    )
    named = stored(named, "fingerprint-classes")
    return prints.join(named, F.col("fp") == F.col("of"), "left").select("id", "fp", "component_id")


def classes(
    docs: DataFrame, scheme: Scheme = BITS_64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, fp, component_id (the smallest id that links lead to)."""
    prints = stored(fingerprints(_texts(docs, id_col, text_col), scheme), "fingerprints")
    found = _classes(prints, scheme)
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(
    docs: DataFrame, scheme: Scheme = BITS_64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their class, with all their columns.

    Rows that share an identifier stay or go together; rows without one stay.
    """
    found = classes(docs, scheme, id_col, text_col)
    name = unused("gone", docs)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(stored(gone, "near-copies"), F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
