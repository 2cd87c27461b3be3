"""Short codes for vectors: each of several parts is replaced by the number of its nearest codebook entry.

Components become the integers floor(SCALE * x), and all arithmetic after that is in integers, so results do not depend on
order, blocks or partitions. A vector is cut into equal consecutive parts; each part position has a codebook that starts as
that part of the vectors with the smallest identifiers and is moved to the (rounded down) means of its nearest parts
for some rounds. Ties go to the lower entry; entries that nobody is nearest to stay.

The parts of a position are sorted along a Hilbert curve, so that neighbours on the curve are near each other, and stored
in flat blocks with their boxes (smallest and largest value of each component) and sums. A round compares boxes with the
codebook first: an entry whose least distance to the box exceeds another entry's largest distance is nearest to no part in
it. What is left is the block's short list. If that is one entry, the block's sum goes to it as it is; otherwise the
short list is compared with each part. Spark reads the blocks of a round in tasks of their own; a task sends the counts and
sums of each entry, and only codebooks pass through the driver (entries x dimensions numbers).

Equal and near parts lie in one range of the curve; ranges are cut by (position, curve, row), so a vector
with any share of the rows is spread over tasks.

Defined results: rows whose vector is null or has null or non-finite components are left out, and so are rows whose vector has
another length than that of the smallest kept identifier; a null identifier counts as larger than any other; equal
identifiers are ordered by their vectors, and each row has its own code; with fewer rows than entries, codebooks have as many entries
as there are rows; an empty table gives an empty table; other columns are not read, whatever their names. A length that the number
of parts does not divide is an error, and so is a component beyond +-LARGEST / SCALE: squared distances would
not fit a long number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import stored

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Parts of a block.
BLOCK = 256
#: Integers beyond this are refused: the squares of 64 differences of them fit 63 bits.
LARGEST = 1 << 27
#: Bits of a place on the curve, below those of the part's position.
CURVE_BITS = 56


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """row (a number of its own), id, label, vector; written, so that the numbers stay."""
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector")
    ).where(F.col("vector").isNotNull() & finite)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "kept-vectors")


def _integers(column: pa.Array, length: int) -> np.ndarray:
    """The vectors as rows of integers."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    found = np.floor(flat.reshape(len(column), length) * SCALE)
    if found.size and np.abs(found).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / SCALE}")
    return found.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """How vectors are cut, and where the curve of each position runs: middle and spread of its components."""

    length: int
    parts: int
    middle: tuple[float, ...]
    spread: tuple[float, ...]
    largest: int

    @property
    def width(self) -> int:
        return self.length // self.parts

    @property
    def dtype(self) -> type:
        """The narrowest integers that hold the components."""
        return np.int16 if self.largest < 1 << 15 else np.int32


def _layout(kept: DataFrame, length: int, parts: int) -> Layout:
    width = length // parts

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, 3))
        largest = 0
        for batch in batches:
            values = _integers(batch.column(0), length).reshape(batch.num_rows, parts, width).astype(np.float64)
            total += np.stack([values.size / parts + np.zeros(parts), values.sum((0, 2)), (values**2).sum((0, 2))], axis=1)
            largest = max(largest, int(np.abs(values).max(initial=0)))
        columns = [np.arange(parts), *total.T, np.full(parts, largest)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "n", "s", "q", "largest"])

    rows = (
        kept.select("vector")
        .mapInArrow(moments, "part long, n double, s double, q double, largest long")
        .groupBy("part")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("largest").alias("largest"))
        .orderBy("part")
        .collect()
    )
    middle = [r.s / max(r.n, 1) for r in rows]
    spread = [max(1.0, (max(0.0, r.q / max(r.n, 1) - m * m)) ** 0.5) for r, m in zip(rows, middle, strict=True)]
    return Layout(length, parts, tuple(middle), tuple(spread), max((r.largest for r in rows), default=0))


def hilbert_places(values: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of numbers below 2**bits (Skilling, 2004)."""
    x = values.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(n):
            upper = (x[i] >> np.uint64(b)) & one == one
            swapped = np.where(upper, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swapped)
            x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turned ^= np.where((x[n - 1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turned
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << one | (x[i] >> np.uint64(b)) & one
    return place


def _on_curve(kept: DataFrame, layout: Layout) -> DataFrame:
    """A row per part: place (position and place on the curve), row, and the part's integers as bytes."""
    parts, width = layout.parts, layout.width
    bits = max(1, min(16, CURVE_BITS // max(width, 1)))
    # Wide parts have more bits than a number: their first components order them.
    used = min(width, CURVE_BITS)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _integers(batch.column("vector"), layout.length).reshape(batch.num_rows, parts, width)
            places = np.zeros((batch.num_rows, parts), np.int64)
            for p in range(parts if used else 0):
                # Three times the spread on either side, in 2**bits steps.
                cell = (values[:, p, :used] - layout.middle[p]) / (6 * layout.spread[p]) + 0.5
                steps = np.clip(np.floor(cell * (1 << bits)), 0, (1 << bits) - 1)
                places[:, p] = hilbert_places(steps, bits).astype(np.int64)
            places += np.arange(parts, dtype=np.int64) << CURVE_BITS
            flat = values.astype(layout.dtype).tobytes()
            size = width * np.dtype(layout.dtype).itemsize
            offsets = np.arange(batch.num_rows * parts + 1, dtype=np.int32) * size
            binary = pa.BinaryArray.from_buffers(
                pa.binary(), batch.num_rows * parts, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]
            )
            row = np.repeat(batch.column("row").to_numpy(), parts)
            yield pa.RecordBatch.from_arrays([pa.array(places.reshape(-1)), pa.array(row), binary], ["place", "row", "part"])

    return kept.select("row", "vector").mapInArrow(placed, "place long, row long, part binary")


BLOCK_SCHEMA = "position int, rows binary, parts binary, low array<long>, high array<long>, total array<long>"


def _blocks(curve: DataFrame, layout: Layout) -> DataFrame:
    """The parts in flat blocks: position, rows and parts as bytes, the box and the sum."""
    width = layout.width

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            position = batch.column("place").to_numpy() >> CURVE_BITS
            row = batch.column("row").to_numpy()
            values = np.frombuffer(b"".join(batch.column("part").to_pylist()), layout.dtype).reshape(batch.num_rows, width)
            new = np.flatnonzero(np.concatenate(([True], position[1:] != position[:-1])))
            out = []
            for start, stop in zip(new, [*new[1:], batch.num_rows], strict=True):
                for at in range(start, stop, BLOCK):
                    own = values[at : min(stop, at + BLOCK)]
                    box = (own.min(axis=0), own.max(axis=0), own.sum(axis=0, dtype=np.int64))
                    out.append((position[at], row[at : at + len(own)].tobytes(), own.tobytes(), *(b.tolist() for b in box)))
            lists = pa.list_(pa.int64())
            types = (pa.int32(), pa.binary(), pa.binary(), lists, lists, lists)
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["position", "rows", "parts", "low", "high", "total"])

    ranged = curve.repartitionByRange("place", "row").sortWithinPartitions("place", "row")
    return stored(ranged.mapInArrow(packed, BLOCK_SCHEMA), "vector-blocks")


def short_list(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entries that can be nearest to a point of the box: those not farther than another one's farthest corner."""
    below, above = entries - low, high - entries
    least = np.maximum(np.maximum(-below, -above), 0)
    most = np.maximum(np.abs(below), np.abs(above))
    return np.flatnonzero((least * least).sum(axis=1) <= (most * most).sum(axis=1).min())


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part the number of the nearest entry (the lowest of equally near ones) and the squared distance."""
    apart = parts[:, None, :] - entries[None, :, :]
    squared = np.einsum("ijk,ijk->ij", apart, apart)
    found = squared.argmin(axis=1)
    return found, squared[np.arange(len(parts)), found]


def _read_blocks(batch: pa.RecordBatch, layout: Layout) -> Iterator[tuple]:
    """Of each block: position, rows as bytes, parts, and the box's low and high corners and the sum."""
    boxes = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, layout.width) for c in ("low", "high", "total"))
    for position, rows, parts, low, high, total in zip(
        batch.column("position").to_pylist(), batch.column("rows"), batch.column("parts"), *boxes, strict=True
    ):
        n = len(rows.as_buffer()) // 8
        values = np.frombuffer(parts.as_buffer(), layout.dtype).reshape(n, layout.width)
        yield position, rows.as_buffer(), values, low, high, total


def _moved(blocks: DataFrame, layout: Layout, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for position, _, values, low, high, block_total in _read_blocks(batch, layout):
                book = books[position]
                listed = short_list(low, high, book)
                if len(listed) == 1:
                    count[position, listed[0]] += len(values)
                    total[position, listed[0]] += block_total
                    continue
                own = values.astype(np.int64)
                found, _ = nearest(own, book[listed])
                count[position, listed] += np.bincount(found, minlength=len(listed))
                for number in np.unique(found):
                    total[position, listed[number]] += own[found == number].sum(axis=0)
        # A part without components has a count all the same.
        flat = np.concatenate([count[:, :, None], total], axis=2)
        index = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(flat.reshape(-1)[index])], ["at", "value"])

    sums = np.zeros(parts * entries * (width + 1), object)
    gathered_rows = blocks.mapInArrow(gathered, "at long, value long")
    for row in gathered_rows.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        sums[row["at"]] = int(row.value)
    sums = sums.reshape(parts, entries, width + 1)
    moved = books.copy()
    for position in range(parts):
        for entry in range(entries):
            n = sums[position, entry, 0]
            if n:
                moved[position, entry] = [int(s) // n for s in sums[position, entry, 1:]]
    return moved


def _coded(blocks: DataFrame, layout: Layout, books: np.ndarray) -> DataFrame:
    """row, digits (the entry's number at its part's place in the code) and error of every part."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for position, rows, values, low, high, _ in _read_blocks(batch, layout):
                listed = short_list(low, high, books[position])
                found, error = nearest(values.astype(np.int64), books[position][listed])
                digits = listed[found].astype(np.int64) << 8 * (layout.parts - 1 - position)
                row = np.frombuffer(rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (row, digits, error)], ["row", "digits", "error"])

    return blocks.mapInArrow(assigned, "row long, digits long, error long")


def _digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """A row per kept vector: id, code (two hexadecimal digits for each part), error (squared distances to
    the code's entries), label_error (summed over rows of the same label), codebooks_sha256.

    At most 8 parts of at most 127 entries, whose numbers fit one long number.
    """
    kept = _kept(vectors, id_col, vector_col, label_col)
    # As many rows as a codebook has entries.
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector", "row").select("vector").limit(1).collect()
    if not first:
        names = f"`{id_col}` {kept.schema['id'].dataType.simpleString()}, code string, error long, label_error long"
        return vectors.sparkSession.createDataFrame([], names + ", codebooks_sha256 string")
    length = len(first[0].vector)
    if length % parts:
        raise ValueError(f"{length} components have no {parts} equal parts")
    kept = kept.where(F.size("vector") == length)
    smallest = kept.orderBy(F.col("id").asc_nulls_last(), "vector", "row").select("vector").limit(entries).toArrow()
    seeds = _integers(smallest.column(0).combine_chunks(), length)
    books = seeds.reshape(len(seeds), parts, length // parts).transpose(1, 0, 2).copy()
    layout = _layout(kept, length, parts)
    blocks = _blocks(_on_curve(kept, layout), layout)
    for _ in range(rounds):
        books = _moved(blocks, layout, books)
    codes = (
        _coded(blocks, layout, books)
        .groupBy("row")
        .agg(F.bit_or("digits").alias("digits"), F.sum("error").alias("error"))
        .join(kept.select("row", "id", "label"), "row")
    )
    codes = stored(codes, "vector-codes")
    of_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("digits"), 2 * parts, "0")).alias("code"),
        "error",
        "label_error",
        F.lit(_digest(books)).alias("codebooks_sha256"),
    )
