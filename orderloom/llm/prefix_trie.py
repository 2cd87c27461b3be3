"""Conversations as a trie of their prefixes, by ROLLUP over positional columns of turn ids.

Each distinct sequence of the first d turns (role and text) of a conversation is a node of depth d. A
conversation is laid out in blocks of ``WIDTH`` turns: a row per block, with a column per position that holds the
id of the turn there (128 bits of hash of role and text) and null after the conversation's end. One

    GROUP BY block, node of the block before, ROLLUP (turn id 1, ..., turn id WIDTH)

aggregates all prefixes of all blocks together; ``grouping_id`` tells the depth within the block. Long
conversations go on in further blocks, which are keyed by the node that ended the block before, so neither the
columns nor the steps grow with the longest conversation. The node of a prefix is named by the exclusive
or of the hashes of its (position, turn id), so the key of a block is a running aggregate of the blocks before it.

What a node shares is summed over whole subtrees without walking them. If a conversation is the smallest member of
a node, it is the smallest of all deeper nodes on its path: from some depth on, its turns are new, and
before that depth each of its turns repeats a turn of a smaller conversation. So the turns saved in a
subtree are the sum, over its members, of each one's repeated turns in the subtree, and its leaves are the members
that are smallest in a childless node: both are sums over members, which a second ROLLUP takes.

Conversations are cut and numbered over sorted ranges, so a conversation with a large share of the rows is spread
over tasks. A node with many members is pre-aggregated by each task. The list of the conversations that end in a
node is hashed as a stream over sorted ranges; only nodes at the border of a range are put together by
one task each, from text pieces of bounded size. (SHA-256 has an order, so that one stream cannot be split.)

Defined results: a null role or text is empty; turns are in the order of the turn number, null first, then
role, then text, so repeated rows are turns of their own; rows without conversation id belong to none and are left
out; an empty table has no nodes; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import stored, text_of, word_count

#: Turns of a block.
WIDTH = 8
#: Identifiers that one piece of text joins.
PIECE_IDS = 1 << 16
POSITIONS = range(1, WIDTH + 1)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: the number of the range, and the row's place in its conversation within the range."""
    pid, last, done = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        place = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv)))) + 1
        if conv[0] == last:
            first_run = starts[1] if len(starts) > 1 else len(conv)
            place[:first_run] += done
        last, done = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(conv), pid, np.int32)), pa.array(place.astype(np.int64)), *batch.columns],
            ["pid", "place", *batch.schema.names],
        )


def numbered(turns: DataFrame) -> DataFrame:
    """Of (conv_id, turn, role, text) rows: conv, pos (from 1), the turn's id (a, b) and its words."""
    role, text = text_of("role"), text_of("text")
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text")
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = rows.select(
        "conv",
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit("second half"), "text", "role").alias("b"),
        word_count(F.col("text")).alias("words"),
    )
    placed = stored(narrow.mapInArrow(_places, "pid int, place long, conv long, a long, b long, words long"), "turn-places")
    # Only the first conversation of a range can have begun in an earlier one: as few rows as there are ranges.
    before = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy("conv", "pid").agg(F.max("place").alias("n"))
    begun = pieces.withColumn("begun", F.sum("n").over(before)).where("begun is not null").drop("n")
    return placed.join(F.broadcast(begun), ["conv", "pid"], "left").select(
        "conv", (F.col("place") + F.coalesce("begun", F.lit(0))).alias("pos"), "a", "b", "words"
    )


def _turn_hashes(depth: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """128 bits for a turn at a depth."""
    return F.xxhash64(depth, a, b), F.xxhash64(b, depth, a)


def _blocks(turns: DataFrame) -> DataFrame:
    """A row for each block of each conversation.

    conv, block, turn ids a1, b1, ... and words w1, ...; the node (q1, q2) of the block before; the node (e1, e2) in
    which the conversation ends, in the row of its last block only; its number of turns.
    """
    pos = F.col("pos")
    cut = turns.withColumn("block", F.coalesce(F.floor((pos - 1) / F.lit(WIDTH)), F.lit(0)).cast("long"))
    h1, h2 = _turn_hashes(pos, F.col("a"), F.col("b"))
    cut = cut.withColumn("h1", F.when(pos.isNotNull(), h1)).withColumn("h2", F.when(pos.isNotNull(), h2))
    at = {j: pos == F.col("block") * WIDTH + j for j in POSITIONS}
    blocks = cut.groupBy("conv", "block").agg(
        *(F.max(F.when(at[j], F.col(c))).alias(f"{c[0]}{j}") for j in POSITIONS for c in ("a", "b", "words")),
        *(F.coalesce(F.bit_xor(h), F.lit(0)).alias(f"x{h[1]}") for h in ("h1", "h2")),
        F.count("pos").alias("n"),
    )
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    for side in "12":
        blocks = blocks.withColumn(f"q{side}", F.coalesce(F.bit_xor(f"x{side}").over(before), F.lit(0)))
    last = F.col("block") == F.max("block").over(whole)
    return blocks.select(
        "*",
        F.sum("n").over(whole).alias("length"),
        *(F.when(last, F.col(f"q{s}").bitwiseXOR(F.col(f"x{s}"))).alias(f"e{s}") for s in "12"),
    ).drop("x1", "x2", "n")


def _rolled_up(blocks: DataFrame, sums: dict[str, str] | None = None, by_level: dict[str, list[str]] | None = None) -> DataFrame:
    """All prefixes of all blocks: a row per node with its key (k1, k2), its parent's (p1, p2), depth and aggregates.

    ``sums`` are SQL expressions that are summed over a node's members; those of ``by_level`` have one for each level
    in the block, from 0 to WIDTH.
    """
    sums, by_level = sums or {}, by_level or {}
    ids = ", ".join(f"(a{j}, b{j})" for j in POSITIONS)
    totals = [f"sum({part}) AS {name}" for name, part in sums.items()]
    totals += [f"sum({part}) AS {name}_{level}" for name, parts in by_level.items() for level, part in enumerate(parts)]
    columns = ", ".join(f"{c}{j}" for j in POSITIONS for c in "ab")
    grouped = blocks.sparkSession.sql(
        f"""
        SELECT block, q1, q2, {columns}, CAST({WIDTH} - bit_count(grouping_id()) / 2 AS int) AS level,
               min(conv) AS conv_id, count(*) AS n_convs{"".join(", " + total for total in totals)}
        FROM {{blocks}} GROUP BY block, q1, q2, ROLLUP ({ids})
        """,
        blocks=blocks,
    )
    # Past a conversation's end the columns are null, which is no node; a block's empty prefix is a node of the block before.
    level = F.col("level")
    present = F.when(level == 0, F.col("block") == 0)
    for j in POSITIONS:
        present = present.when(level == j, F.col(f"a{j}").isNotNull())
    depth = F.col("block") * WIDTH + level
    key, parent = {}, {}
    hashes = {j: _turn_hashes(F.col("block") * WIDTH + j, F.col(f"a{j}"), F.col(f"b{j}")) for j in POSITIONS}
    for s in (1, 2):
        key[s] = parent[s] = F.col(f"q{s}")
        for j in POSITIONS:
            key[s] = key[s].bitwiseXOR(F.when(level >= j, hashes[j][s - 1]).otherwise(F.lit(0)))
            parent[s] = parent[s].bitwiseXOR(F.when(level > j, hashes[j][s - 1]).otherwise(F.lit(0)))
    picked = []
    for name in by_level:
        of_level = F.when(level == 0, F.col(f"{name}_0"))
        for j in POSITIONS:
            of_level = of_level.when(level == j, F.col(f"{name}_{j}"))
        picked.append(of_level.cast("long").alias(name))
    return grouped.where(present).select(
        *(key[s].alias(f"k{s}") for s in key),
        *(F.when(depth > 0, parent[s]).alias(f"p{s}") for s in parent),
        depth.cast("long").alias("depth"),
        "conv_id",
        "n_convs",
        *(F.col(name).cast("long").alias(name) for name in sums),
        *picked,
    )


def _repeated(blocks: DataFrame, nodes: DataFrame, children: DataFrame) -> DataFrame:
    """The blocks with the words of repeated turns only, those of later blocks (tail), and whether the
    conversation is the smallest in a childless node (leaf)."""
    childless = nodes.join(children, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    firsts = (
        childless.groupBy(F.col("conv_id").alias("first_of"))
        .agg(
            F.count_if(F.col("depth") > 0).alias("n_new"),
            F.max(F.col("n_children").isNull().cast("int")).alias("leaf"),
        )
    )
    known = blocks.join(firsts, F.col("conv") == F.col("first_of"), "left")
    first_new = F.col("length") - F.coalesce("n_new", F.lit(0)) + 1
    known = known.select(
        *(c for c in blocks.columns if not (c[0] == "w" and c[1:].isdigit())),
        *(
            F.when(F.col("block") * WIDTH + j < first_new, F.coalesce(F.col(f"w{j}"), F.lit(0))).otherwise(0).alias(f"w{j}")
            for j in POSITIONS
        ),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    after = Window.partitionBy("conv").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = sum((F.col(f"w{j}") for j in POSITIONS), F.lit(0))
    return known.withColumn("tail", F.coalesce(F.sum(own).over(after), F.lit(0)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k1, k2, conv) in order: the conversations of each node as text, in pieces of PIECE_IDS.

    ``whole`` tells that a piece is all of its node's: neither the first nor the last of the range, and not cut.
    """
    names = ["k1", "k2", "first", "piece", "whole"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    node, ids, whole, out = None, [], False, []

    def finished(rows):
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def flush(is_whole):
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids)), is_whole))
            ids.clear()

    for batch in batches:
        for *key, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv")), strict=True):
            if key != node:
                flush(whole)
                whole, node = node is not None, key
            elif len(ids) == PIECE_IDS:
                whole = False
                flush(whole)
            ids.append(conv)
        yield finished(out)
        out.clear()
    flush(False)
    yield finished(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in order: the SHA-256 of each node's, joined by commas, one piece at a time."""
    node, digest = None, None

    def finished(rows):
        columns = zip(*rows, strict=True) if rows else [()] * 3
        types = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k1", "k2", "ends_sha256"]
        )

    for batch in batches:
        out = []
        for *key, piece in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "piece")), strict=True):
            if key == node:
                digest.update(b"," + piece.encode())
                continue
            if node is not None:
                out.append((*node, digest.hexdigest()))
            node, digest = key, hashlib.sha256(piece.encode())
        yield finished(out)
    if node is not None:
        yield finished([(*node, digest.hexdigest())])


def _end_digests(blocks: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes in which conversations end."""
    order = ["k1", "k2", "conv"]
    ends = blocks.where("e1 is not null").select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv")
    ranged = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stored(ranged.mapInArrow(_joined, "k1 long, k2 long, first long, piece string, whole boolean"), "end-pieces")
    parts = pieces.where("not whole").select("k1", "k2", "first", "piece").repartition("k1", "k2")
    streamed = parts.sortWithinPartitions("k1", "k2", "first").drop("first")
    alone = pieces.where("whole").select("k1", "k2", F.sha2("piece", 256).alias("ends_sha256"))
    return alone.unionByName(streamed.mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string"))


def build(turns: DataFrame) -> DataFrame:
    """The trie of (conv, pos, a, b, words) rows, as ``numbered`` makes them; a row with null pos stands for a
    conversation that may have no turns.

    One row per node: key (k1, k2), the parent's key (p1, p2), depth, conv_id (the smallest member: turn
    number ``depth`` of it is the node's last), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    blocks = stored(_blocks(turns), "turn-blocks")
    nodes = stored(_rolled_up(blocks), "trie-nodes")
    children = (
        nodes.where("depth > 0")
        .groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2"))
        .agg(F.count("*").alias("n_children"))
    )
    children = stored(children, "trie-children")
    marked = _repeated(blocks, nodes, children)
    saved = ["tail" + "".join(f" + w{j}" for j in POSITIONS if j >= level) for level in range(WIDTH + 1)]
    totals = _rolled_up(marked, {"n_leaves": "leaf"}, {"saved_tokens": saved})
    parents = nodes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("conv_id").alias("parent_conv_id"))
    both = (F.col("p1") == F.col("c1")) & (F.col("p2") == F.col("c2"))
    # The children of one node may be a third of all: they are written before, so that the join may split them.
    found = stored(totals, "trie-totals").join(parents, both, "left").drop("c1", "c2")
    own = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    return (
        found.join(children, own, "left")
        .drop("c1", "c2")
        .join(_end_digests(blocks), ["k1", "k2"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    )
