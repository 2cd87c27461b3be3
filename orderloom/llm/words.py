"""Words of Arrow batches as numbers, whole columns at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one step works on; a single longer text is a step of its own.
STEP_BYTES = 4 << 20


def in_steps(batches: Iterator[pa.RecordBatch], text_col: str, step_bytes: int = STEP_BYTES):
    """Slices of the batches with at most ``step_bytes`` of text, or one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False))
        start, n = 0, batch.num_rows
        while start < n:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + step_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and for each text where its words start (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return flat.filter(real), before[bounds]


def hashed_words(
    words: pa.Array, form: Callable[[bytes], bytes] | None = None, seed: int = 0
) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(code of each word, hash of each code, each code's word); ``form`` is what of a word is hashed."""
    coded = words.dictionary_encode()
    vocabulary = coded.dictionary.cast(pa.binary()).to_pylist()
    seen = vocabulary if form is None else map(form, vocabulary)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in seen), np.uint64, len(vocabulary))
    return coded.indices.to_numpy(zero_copy_only=False), hashes, vocabulary


def mixed(values: np.ndarray) -> np.ndarray:
    """64 bits scrambled so that any of them can be used."""
    x = values ^ (values >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def segment_ids(starts: np.ndarray) -> np.ndarray:
    """The number of its segment for each element; starts has one entry more than there are segments."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
