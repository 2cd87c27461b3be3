"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's score is the logistic function of the weights of its words and their beginnings, hashed; a document's score is
their noisy-or, 1 - product(1 - p): one offending sentence is enough. The weights are learnt from
document labels alone: the gradient of the document's log-likelihood reaches each sentence through the
noisy-or. Follow-the-regularised-leader updates are made document by document; a word can only add to an
offence, so weights below zero count as zero. Sentences whose own score reaches ``at_least`` are then
located.

A sentence ends with a line, or with a word that ends in . ! or ? (closing quotes and brackets aside).

Training reads a bounded sample of about ``max_rows`` labelled documents, chosen by the hash of their id.

Defined results: a text that is null, empty or without words has no sentence and score 0; a document
without label, or with a null one, is not trained on; of several labels the largest counts; an empty
table gives an empty table; other columns are passed on, but those named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import unused
from orderloom.llm.quality import MAX_ROWS, Ftrl, Settings, trained_weights, logistic, training_rows
from orderloom.llm.words import hashed_words, in_steps, mixed, split_words

SETTINGS = Settings(alpha=3.0, l1=1.0, only_positive=True)
#: Log-odds of a sentence about which nothing is known.
PRIOR = -9.0

#: Beginnings of words that count besides the whole words, in characters.
BEGINNINGS = (3, 4, 5, 7)

_BREAK = b"\x1e"  # stands for the end of a line
_CLOSING = b"\"')]}\xbb"
_MARKS = b".,;:!?\"'()[]{}|*&%$#<>"

OFFENCE = T.ArrayType(
    T.StructType(
        [
            T.StructField("sentence", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)


def _bare(word: bytes) -> bytes:
    return word.strip(_MARKS).decode("utf-8", "ignore").casefold().encode()


def _beginnings(vocabulary: list[bytes], k: int) -> np.ndarray:
    """Hashes of the first k characters of the bare words, apart from those of whole words."""
    starts = (_bare(w).decode()[:k].encode() for w in vocabulary)
    return np.fromiter((xxhash.xxh64_intdigest(w, k) for w in starts), np.uint64, len(vocabulary))


def _ends(word: bytes) -> bool:
    return word == _BREAK or word.rstrip(_CLOSING).endswith((b".", b"!", b"?"))


class Sentences:
    """The words of a block of texts as hashed places, cut into sentences.

    place: of each different word of a sentence, and of its beginnings; sentence: its sentence,
    counted through the block; text: of each sentence;
    first_word: of each sentence within its text.
    """

    def __init__(self, texts: pa.Array, bits: int):
        marked = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", f" {_BREAK.decode()} ")
        words, starts = split_words(marked)
        codes, hashes, vocabulary = hashed_words(words, _bare)
        ends = np.fromiter(map(_ends, vocabulary), bool, len(vocabulary))[codes]
        real = np.fromiter((w != _BREAK for w in vocabulary), bool, len(vocabulary))[codes]
        begins = np.concatenate(([True], ends[:-1])) if len(codes) else np.zeros(0, bool)
        begins[starts[:-1][starts[:-1] < len(codes)]] = True
        number = np.cumsum(begins)[real]  # numbers of sentences without words are missing
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[real]
        at, self.sentence = np.unique(number, return_index=True, return_inverse=True)[1:]
        self.text = text[at]
        self.first_word = at - np.searchsorted(text, self.text)
        self.n_words = np.bincount(self.sentence, minlength=len(at))
        # A word counts once in a sentence, however often it is repeated.
        once = np.unique((self.sentence.astype(np.int64) << 32) | codes[real])
        self.sentence = once >> 32
        views = [hashes, *(_beginnings(vocabulary, k) for k in BEGINNINGS)]
        # A row per word, a column per view of it.
        places = (mixed(np.stack(views, axis=1)) % np.uint64(1 << bits)).astype(np.int32)
        self.place = places[once & 0xFFFFFFFF]
        self.n_texts = len(starts) - 1

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Of each sentence."""
        sums = np.bincount(self.sentence, weights[self.place].sum(axis=1), len(self.text))
        return logistic(PRIOR + sums)


def noisy_or(scores: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    return -np.expm1(np.bincount(text, np.log1p(-np.minimum(scores, 1 - 1e-15)), n_texts))


def _bags(step: pa.RecordBatch, bits: int) -> Iterator[tuple]:
    """Per text: distinct places, which of them each word has, each word's sentence, and the label."""
    s = Sentences(step.column("text"), bits)
    first = np.searchsorted(s.text, np.arange(s.n_texts + 1))
    word = np.searchsorted(s.sentence, first)
    for i, label in enumerate(step.column("label").to_pylist()):
        own = slice(word[i], word[i + 1])
        if own.stop > own.start:
            places, which = np.unique(s.place[own], return_inverse=True)
            # Kept for the whole training: as small as they can be.
            which = which.astype(np.int32).reshape(-1, s.place.shape[1])
            yield places.astype(np.int32), which, (s.sentence[own] - first[i]).astype(np.int32), label


def learn(model: Ftrl, bag: tuple) -> None:
    """One update from one document."""
    places, which, sentence, label = bag
    w = model.weights(places)
    p = logistic(PRIOR + np.bincount(sentence, w[which].sum(axis=1)))
    none = np.exp(np.sum(np.log1p(-np.minimum(p, 1 - 1e-12))))
    of_sentence = -p * none / max(1 - none, 1e-9) if label else p
    of_word = np.repeat(of_sentence[sentence], which.shape[1])
    model.step(places, np.bincount(which.ravel(), of_word, len(places)), w)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    allowed: Column | None = None,
    max_rows: int = MAX_ROWS,
    settings: Settings = SETTINGS,
) -> np.ndarray:
    """Weights of words learnt from the labelled documents that ``allowed`` (on labels) lets in."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Ftrl:
        model = Ftrl(settings)
        bags = [bag for step in in_steps(batches, "text") for bag in _bags(step, settings.bits)]
        for _ in range(settings.passes):
            for bag in bags:
                learn(model, bag)
        return model

    rows = training_rows(docs, labels, label_col, id_col, text_col, allowed, max_rows)
    return trained_weights(rows, fitted, settings, "mil")


def score(
    docs: DataFrame,
    weights: np.ndarray,
    settings: Settings = SETTINGS,
    text_col: str = "text",
    score_col: str = "score",
    offences_col: str = "offences",
    at_least: float = 0.5,
) -> DataFrame:
    """``docs`` with the probability of being toxic, and the sentences that are."""
    docs = docs.drop(score_col, offences_col)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(offences_col, OFFENCE)]
    )
    names = [*docs.columns, score_col, offences_col]
    place = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kind = pa.list_(
        pa.struct(
            [("sentence", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())]
        )
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for step in in_steps(batches, text_col):
            s = Sentences(step.column(place), settings.bits)
            p = s.scores(w)
            first = np.searchsorted(s.text, np.arange(s.n_texts))
            located: list[list] = [[] for _ in range(s.n_texts)]
            for i in np.flatnonzero(p >= at_least).tolist():
                located[s.text[i]].append(
                    {
                        "sentence": i - int(first[s.text[i]]),
                        "first_word": int(s.first_word[i]),
                        "n_words": int(s.n_words[i]),
                        "score": float(p[i]),
                    }
                )
            columns = [*step.columns, pa.array(noisy_or(p, s.text, s.n_texts)), pa.array(located, kind)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(scored, schema)


def drop_toxic(docs: DataFrame, weights: np.ndarray, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``at_least``, with all their columns."""
    score_col, offences_col = unused("toxicity", docs), unused("offences", docs)
    scored = score(docs, weights, text_col=text_col, score_col=score_col, offences_col=offences_col)
    return scored.where(F.col(score_col) < at_least).drop(score_col, offences_col)
