"""Quality by hashed word n-grams and logistic regression with FTRL updates.

Every text becomes a sparse vector: its words, word pairs, word shapes, and whether a pair repeats one
word, hashed to 2**bits places; the square roots of the counts of each kind are scaled to length 1. The model is trained with
follow-the-regularised-leader updates (McMahan et al., 2013), one labelled document after the other, and a
score is the logistic function of the sparse dot product of a text and the weights.

Training reads a bounded sample: about ``max_rows`` labelled documents, chosen by the hash of their id,
or all if there are fewer. One task learns from them in the order of that hash, so reruns agree. What comes
back to the driver are the weights that are not zero, at most 2**bits.

Defined results: a text that is null, empty or without words has only the bias, and so a score; a
document without label, or with a null one, is not trained on; of several labels the largest counts; if
there are no labels, all scores are the logistic function of zero; an empty table gives an empty
table; other columns are passed on, but one named as the
result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import stored
from orderloom.llm.words import hashed_words, in_steps, mixed, segment_ids, split_words

#: Labelled documents that a model is trained on, about.
MAX_ROWS = 8_000


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 1e-4
    passes: int = 3
    #: Whether weights below zero count as zero.
    only_positive: bool = False


SETTINGS = Settings()


#: Letters as A or a, digits as 0.
_CLASSES = bytes(
    65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c > 127 else 48 if 48 <= c < 58 else c for c in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    """The kinds of characters of a word, each run as one: Wort,*** has the shape Aa,*"""
    return _RUNS.sub(rb"\1", word.translate(_CLASSES))


def _counted(rows: np.ndarray, hashed: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row and place as one key, value) of one kind of feature: square roots of counts, length 1 per row."""
    places = mixed(hashed) % np.uint64((1 << bits) - 1) + np.uint64(1)
    keys, counts = np.unique((rows.astype(np.uint64) << np.uint64(32)) | places, return_counts=True)
    row = (keys >> np.uint64(32)).astype(np.int64)
    return keys, np.sqrt(counts / np.bincount(row, counts, n)[row])


def sparse_rows(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of the texts: (row starts, places, values), places ascending within a row.

    Place 0 is the bias, which has value 1 in every row.
    """
    words, starts = split_words(texts)
    codes, hashes, vocabulary = hashed_words(words)
    shapes = np.fromiter((xxhash.xxh64_intdigest(shape(w), 1) for w in vocabulary), np.uint64, len(vocabulary))
    rows = segment_ids(starts)
    own = hashes[codes]
    within = np.ones(len(own), bool)
    within[starts[:-1][starts[:-1] < len(own)]] = False  # no pair reaches back over a text's start
    pairs = np.flatnonzero(within)
    both = mixed(own[pairs - 1]) * np.uint64(3) + own[pairs]
    n = len(texts)
    repeats = (own[pairs] == own[pairs - 1]).astype(np.uint64) + np.uint64(1)
    kinds = ((rows, own), (rows[pairs], both), (rows, shapes[codes]), (rows[pairs], repeats))
    keys, value = map(np.concatenate, zip(*(_counted(r, hashed, bits, n) for r, hashed in kinds), strict=True))
    order = np.argsort(keys, kind="stable")
    keys, value = keys[order], value[order]
    row = (keys >> np.uint64(32)).astype(np.int64)
    # The bias goes before each row's own places.
    ends = np.searchsorted(row, np.arange(n + 1))
    at = ends[:-1]
    return (
        ends + np.arange(n + 1),
        np.insert((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), at, 0),
        np.insert(value, at, 1.0),
    )


class Ftrl:
    """Weights of a logistic regression under follow-the-regularised-leader updates."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z = np.zeros(1 << settings.bits)
        self.n = np.zeros(1 << settings.bits)

    def weights(self, places) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.s.l1, 0.0)
        if self.s.only_positive:
            shrunk = np.minimum(shrunk, 0.0)
        return -shrunk / ((self.s.beta + np.sqrt(n)) / self.s.alpha + self.s.l2)

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(places)
        self.step(places, (logistic(w @ values) - label) * values, w)

    def step(self, places: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        """Take in the gradient at distinct places that have the weights w."""
        squared = gradient * gradient
        n = self.n[places]
        self.z[places] += gradient - (np.sqrt(n + squared) - np.sqrt(n)) / self.s.alpha * w
        self.n[places] = n + squared


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def training_rows(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, allowed: Column | None, max_rows: int
) -> DataFrame:
    """(h, label, text) of labelled documents: all, or about ``max_rows`` chosen by the hash of the id.

    Only the chosen labels, about max_rows rows, meet the documents; they are small enough to
    broadcast, and the texts of other documents are not moved.
    """
    key, label = F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("int")
    marked = labels.where(allowed) if allowed is not None else labels
    marked = marked.select(key.alias("key"), label.alias("label")).where("key is not null and label is not null")
    marked = marked.groupBy("key").agg(F.max("label").alias("label"))
    share = max_rows / max(1, marked.count())
    h = F.xxhash64("key", F.lit("train"))
    if share < 1:
        marked = marked.where(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(key.alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(marked), "key").select(h.alias("h"), "label", "text")


def trained_weights(rows: DataFrame, fitted: Callable, settings: Settings, label: str) -> np.ndarray:
    """Weights of the model that ``fitted`` makes of the bounded sample, one after the other in one task."""

    def weights_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = fitted(batches).weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["place", "w"])

    in_order = rows.repartition(1).sortWithinPartitions("h", "text")
    learnt = stored(in_order.mapInArrow(weights_of, "place long, w double"), label).toArrow()
    weights = np.zeros(1 << settings.bits)
    weights[learnt.column("place").to_numpy()] = learnt.column("w").to_numpy()
    return weights


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    allowed: Column | None = None,
    max_rows: int = MAX_ROWS,
    settings: Settings = SETTINGS,
) -> np.ndarray:
    """Weights learnt from the labelled documents that ``allowed`` (a condition on labels) lets in."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Ftrl:
        model, seen = Ftrl(settings), []
        for step in in_steps(batches, "text"):
            starts, places, values = sparse_rows(step.column("text"), settings.bits)
            for i, label in enumerate(step.column("label").to_pylist()):
                own = slice(starts[i], starts[i + 1])
                # Kept for the whole training: as small as they can be.
                seen.append((places[own].astype(np.int32), values[own].astype(np.float32), label))
        for _ in range(settings.passes):
            for places, values, label in seen:
                model.update(places, values, label)
        return model

    rows = training_rows(docs, labels, label_col, id_col, text_col, allowed, max_rows)
    return trained_weights(rows, fitted, settings, "ftrl")


def score(
    docs: DataFrame,
    weights: np.ndarray,
    settings: Settings = SETTINGS,
    text_col: str = "text",
    out_col: str = "score",
) -> DataFrame:
    """``docs`` with the probability of label 1."""
    docs = docs.drop(out_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    place = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for step in in_steps(batches, text_col):
            starts, places, values = sparse_rows(step.column(place), settings.bits)
            sums = np.add.reduceat(w[places] * values, starts[:-1])
            yield pa.RecordBatch.from_arrays(
                [*step.columns, pa.array(logistic(sums))], [*step.schema.names, out_col]
            )

    return docs.mapInArrow(scored, schema)
