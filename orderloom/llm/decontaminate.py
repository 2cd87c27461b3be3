"""Documents that contain a benchmark item, found by edit distance on words.

Windows of words are embedded by the CGK random walk (Chakraborty, Goldenberg, Koucky, 2016): in each step
the embedding emits the word the walk is at, and the word and the step decide by a random bit whether the
walk moves on. Strings at a small edit distance mostly get embeddings at a small Hamming distance, as
the walks meet again after an edit. Bit sampling then is the hash: a few sampled steps of the embedding.
Walk and sample are repeated until edited copies of the items, made for the purpose, are found at the
target recall: for each quarter of a window's range of lengths, with as many edits as its shortest items allow, and
at last on copies that no repetition was chosen by. Each match is verified by the exact edit distance.

Windows are item-sized: items of m to 2m-1 words (m a power of two) share a window of about 3m/4 words. A
document's windows start every s = m/4 words, an item's at every word, and the window is s-1
words shorter than m, so that wherever an item stands in a document, one of the document's windows is
exactly one of the item's. A document contains an item if some run of its words is within
``floor((1 - similarity) * words of the item)`` insertions, deletions or replacements of words.

Items for which ``MOST_REPEATS`` repetitions do not reach the target are found by plain seeds instead: cut into
one piece more than the edits allowed, one piece is always whole. That is complete, but meets more candidates.
Items of fewer than ``LEAST_WORDS`` words allow no edit, so the whole item is the seed.

The items are the smaller side: they are hashed in blocks of at most ``BLOCK_ITEMS`` items and about
``BLOCK_BYTES`` of text, each sent to the tasks by itself, and every block meets all documents in a pass without shuffle.
Words are compared in lower case and without punctuation around them.

Defined results: a null or empty text contains nothing; an item of no words is nowhere; a short item is
found wherever its words stand in a row, and one common word is an item like any other; items with
equal texts are found each; an empty table of items leaves all documents clean; rows that repeat an identifier are judged each; other columns are passed on.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import unused
from orderloom.llm.words import in_steps, mixed, segment_ids, split_words

#: Items of one block: what a task holds of the benchmark at a time.
BLOCK_ITEMS, BLOCK_BYTES = 10_000, 32 << 20
LEAST_WORDS = 5
SIMILARITY = 0.8
#: Share of items, edited as much as is allowed, that the repetitions shall find.
RECALL = 0.98
#: Edited copies of each quarter of lengths that the recall is measured on.
COPIES = 400
#: Sampled steps of a hash, and the most repetitions that are tried.
SAMPLES, MOST_REPEATS = 4, 48
#: Words around candidates that are looked at together.
REGION_WORDS = 1 << 18
SEED = 8

LEAK = T.ArrayType(
    T.StructType(
        [
            T.StructField("item", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("distance", T.LongType()),
        ]
    )
)
_MARKS = b".,;:!?\"'()[]{}|*&%$#<>"
_FOLD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the numbers of a filter's slots: of whole signatures, and of their beginnings.
_SLOT_BITS, _FIRST_BITS = 18, 16


def _bare(word: bytes) -> bytes:
    return word.strip(_MARKS).decode("utf-8", "ignore").casefold().encode() or word


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each word, hash of each code, where each text's words start)."""
    words, starts = split_words(texts.cast(pa.string()))
    coded = words.dictionary_encode()
    vocabulary = coded.dictionary
    # ASCII words, most of them, are made bare as a whole column.
    trimmed = pc.ascii_lower(pc.ascii_trim(vocabulary, characters=_MARKS.decode()))
    plain = pc.and_(pc.string_is_ascii(vocabulary), pc.greater(pc.binary_length(trimmed), 0))
    bare = pc.if_else(plain, trimmed, vocabulary).cast(pa.binary()).to_pylist()
    for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
        bare[i] = _bare(bare[i])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, bare), np.uint64, len(bare))
    return coded.indices.to_numpy(zero_copy_only=False), hashes, starts


@dataclass(frozen=True)
class Window:
    """Of the items of m to 2m-1 words: the stride of a document's windows, and their length."""

    m: int

    @property
    def stride(self) -> int:
        return max(1, self.m // 4)

    @property
    def length(self) -> int:
        return self.m - self.stride + 1

    @staticmethod
    def of(n_words: int) -> Window:
        return Window(1 << (n_words.bit_length() - 1))


def _random_bits(hashes: np.ndarray, repeat: int, part: int) -> np.ndarray:
    """For each word 64 random bits: whether the walk of a repetition moves on in 64 of its steps."""
    return mixed(hashes + mixed(np.uint64([SEED << 40 | repeat << 20 | part + 1])))


def _sampled_steps(window: Window, repeat: int) -> np.ndarray:
    rng = np.random.default_rng((SEED, window.m, repeat))
    return np.sort(rng.choice(window.length, min(SAMPLES, window.length), replace=False))


def _slot_numbers(signature: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The upper bits, as many as the bitmap has slots for."""
    return signature >> np.uint64(65 - len(bitmap).bit_length())


def _slots(signature: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    return bitmap[_slot_numbers(signature, bitmap)]


def padded(codes: np.ndarray, n_words: int) -> np.ndarray:
    """The words with the last one repeated."""
    return np.append(codes, np.full(n_words, codes[-1]))


def signatures(
    codes: np.ndarray,
    hashes: np.ndarray,
    starts: np.ndarray,
    window: Window,
    repeat: int,
    filters: list[np.ndarray] | None = None,
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the window at each start, of one, two, ... sampled steps of its embedding; the last is its signature.

    ``codes`` are ``padded`` by the window's length, as a walk may leave the words. With ``filters``, a bitmap for each
    sampled step, only starts that pass go on; which these are comes first.
    """
    at, alive = starts.astype(np.int64), np.arange(len(starts))
    out, found = np.zeros(len(starts), np.uint64), []
    sampled, bits = _sampled_steps(window, repeat).tolist(), None
    for step in range(sampled[-1] + 1):
        if step % 64 == 0:
            bits = _random_bits(hashes, repeat, step // 64)
        here = bits[codes[at]]
        if step in sampled:
            out = out * _FOLD + (here ^ np.uint64(step))
            found.append(mixed(out))
            if filters is not None:
                passed = np.flatnonzero(_slots(found[-1], filters[len(found) - 1]))
                at, out, alive, here = at[passed], out[passed], alive[passed], here[passed]
                found[-1] = found[-1][passed]
        here >>= np.uint64(step % 64)
        here &= np.uint64(1)
        at += here.view(np.int64)
    return alive, found


def distances(pattern: list[int], text: list[int], anchored: bool) -> list[int]:
    """Edit distance of the pattern to the best run of words that ends at each word of the text.

    Bit-parallel (Myers, 1999). If anchored, runs start with the text.
    """
    places: dict[int, int] = defaultdict(int)
    for i, word in enumerate(pattern):
        places[word] |= 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, score, out = full, 0, len(pattern), []
    for word in text:
        equal = places.get(word, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        more = (down | ~(horizontal | up)) & full
        less = up & horizontal
        score += bool(more & top) - bool(less & top)
        more = (more << 1 | anchored) & full
        less = less << 1 & full
        up = (less | ~(vertical | more)) & full
        down = more & vertical
        out.append(score)
    return out


def best_run(pattern: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(distance, first, end) of a run of the text that is nearest to the pattern, if near enough."""
    ends = distances(pattern, text, False)
    if not ends or min(ends) > most:
        return None
    best = min(ends)
    end = ends.index(best) + 1
    backwards = distances(pattern[::-1], text[:end][::-1], True)
    return best, end - 1 - backwards.index(best), end


@dataclass
class Index:
    """The windows of a block of items by signature, per window and repetition."""

    item_ids: list[int]
    item_words: list[list[int]]
    most_edits: list[int]
    repeats: dict[int, int] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple] = field(default_factory=dict)
    #: Pieces of items by their number of words: signatures in order, items, places in the item.
    seeds: dict[int, tuple] = field(default_factory=dict)

    @staticmethod
    def of(ids: list[int], texts: list[str | None], similarity: float = SIMILARITY, recall: float = RECALL) -> Index:
        codes, hashes, starts = word_hashes(pa.array(texts, pa.string()))
        words = [hashes[codes[a:b]] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        kept = [i for i, w in enumerate(words) if len(w)]
        index = Index(
            [ids[i] for i in kept],
            [words[i].tolist() for i in kept],
            [int((1 - similarity) * len(words[i]) + 1e-9) if len(words[i]) >= LEAST_WORDS else 0 for i in kept],
        )
        by_window: dict[int, list[int]] = defaultdict(list)
        plain = []
        for i, w in enumerate(index.item_words):
            if len(w) < LEAST_WORDS:
                plain.append(i)
            else:
                by_window[Window.of(len(w)).m].append(i)
        for m, items in by_window.items():
            if not index._add(Window(m), items, recall):
                plain += items
        index._add_seeds(plain)
        return index

    def _add(self, window: Window, items: list[int], recall: float) -> bool:
        """Add repetitions until the copies are found; False, and none, if that takes too many."""
        flat = np.concatenate([np.array(self.item_words[i], np.uint64) for i in items])
        lengths = np.array([len(self.item_words[i]) for i in items])
        n_starts = lengths - window.length + 1
        item = np.repeat(items, n_starts)
        offset = _counting(n_starts)
        begin = np.repeat(np.cumsum(lengths) - lengths, n_starts)
        codes = padded(np.arange(len(flat)), window.length)
        chosen_by = self._copies(window, items, 0)
        found = [np.zeros(COPIES, bool) for _ in chosen_by]
        for repeat in range(MOST_REPEATS):
            _, levels = signatures(codes, flat, begin + offset, window, repeat)
            filters = [np.zeros(1 << (_SLOT_BITS if level is levels[-1] else _FIRST_BITS), bool) for level in levels]
            for bitmap, level in zip(filters, levels, strict=True):
                bitmap[_slot_numbers(level, bitmap)] = True
            order = np.argsort(levels[-1], kind="stable")
            self.tables[window.m, repeat] = (filters, levels[-1][order], item[order], offset[order])
            for band, copies in enumerate(chosen_by):
                found[band] |= self._hits(window, repeat, *copies)
            if all(hits.mean() >= recall for hits in found) and self._holds(window, items, repeat + 1, recall):
                self.repeats[window.m] = repeat + 1
                return True
        for repeat in range(MOST_REPEATS):
            del self.tables[window.m, repeat]
        return False

    def _holds(self, window: Window, items: list[int], repeats: int, recall: float) -> bool:
        """Whether copies made anew are found, too."""
        for copies in self._copies(window, items, repeats):
            hits = np.zeros(COPIES, bool)
            for repeat in range(repeats):
                hits |= self._hits(window, repeat, *copies)
            if hits.mean() < recall:
                return False
        return True

    def _copies(self, window: Window, items: list[int], seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each quarter of the window's lengths that items have: edited copies of its shortest items."""
        bands: dict[int, list[int]] = defaultdict(list)
        for i in sorted(items, key=lambda i: len(self.item_words[i])):
            band = bands[len(self.item_words[i]) * 4 // window.m]
            if len(band) < COPIES and len(self.item_words[band[0] if band else i]) == len(self.item_words[i]):
                band.append(i)
        return [self._edited(window, band, (SEED, window.m, quarter, seed)) for quarter, band in bands.items()]

    def _edited(self, window: Window, items: list[int], seed: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """COPIES copies of the items, in turn, with as many random edits as are allowed, in strange surroundings:
        (words, starts of their windows, copy of each start)."""
        rng = np.random.default_rng(seed)
        words, starts, owner = [], [], []
        for copy in range(COPIES):
            i = items[copy % len(items)]
            text = list(self.item_words[i])
            for _ in range(self.most_edits[i]):
                at, kind = int(rng.integers(len(text))), int(rng.integers(3))
                strange = [int(rng.integers(1 << 62))]
                text[at : at + (kind != 0)] = strange if kind != 2 else []
            pad = rng.integers(1 << 62, size=int(rng.integers(window.stride, 2 * window.stride + 1))).tolist()
            begin = len(words)
            words += pad + text + rng.integers(1 << 62, size=window.length).tolist()
            own = range(begin, len(words) - window.length, window.stride)
            starts += own
            owner += [copy] * len(own)
        return np.array(words, np.uint64), np.array(starts), np.array(owner)

    def _hits(self, window: Window, repeat: int, words: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
        _, levels = signatures(padded(np.arange(len(words)), window.length), words, starts, window, repeat)
        known = np.isin(levels[-1], self.tables[window.m, repeat][1])
        return np.bincount(owner, known, COPIES) > 0

    def _add_seeds(self, items: list[int]) -> None:
        """Pieces of which one is whole in every copy within the distance."""
        pieces: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i in items:
            words = self.item_words[i]
            cuts = [len(words) * k // (self.most_edits[i] + 1) for k in range(self.most_edits[i] + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                signature = int(_run_signatures(np.array(words[a:b], np.uint64), b - a)[0])
                pieces[b - a].append((signature, i, a))
        for n_words, found in pieces.items():
            signature, item, offset = zip(*sorted(found), strict=True)
            self.seeds[n_words] = (np.array(signature, np.uint64), np.array(item), np.array(offset))

    def candidates(
        self, codes: np.ndarray, hashes: np.ndarray, starts: np.ndarray
    ) -> np.ndarray:
        """Distinct (text, item, word of the block at which the item would begin) rows, in order."""
        n, n_items = len(codes), len(self.item_ids)
        if not n or not n_items:
            return np.zeros((0, 3), np.int64)
        # A row is one number; an item can begin before the words.
        before = max(map(len, self.item_words))
        bits = np.int64((n + before).bit_length())

        def packed(at: np.ndarray, which: np.ndarray, offset: np.ndarray) -> np.ndarray:
            return (text[at] * n_items + which << bits) + (at - offset + before)

        text = segment_ids(starts)
        within = np.arange(n) - starts[text]
        found = []
        words = padded(codes, max((Window(m).length for m in self.repeats), default=0))
        for m, repeats in self.repeats.items():
            window = Window(m)
            begin = np.flatnonzero(within % window.stride == 0)
            begin = begin[starts[text[begin] + 1] - begin > window.length // 2]
            for repeat in range(repeats):
                filters, known, item, offset = self.tables[m, repeat]
                maybe, levels = signatures(words, hashes, begin, window, repeat, filters)
                at, which = _matches(known, levels[-1])
                at = begin[maybe[at]]
                found.append(packed(at, item[which], offset[which]))
        for n_words, (known, item, offset) in self.seeds.items():
            signature = _run_signatures(hashes[codes], n_words)
            begin = np.flatnonzero(starts[text[: len(signature)] + 1] - np.arange(len(signature)) >= n_words)
            at, which = _matches(known, signature[begin])
            at = begin[at]
            found.append(packed(at, item[which], offset[which]))
        rows = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        texts, items = np.divmod(rows >> bits, n_items)
        return np.stack((texts, items, (rows & ((1 << bits) - 1)) - before), axis=1)

    def _likely(self, rows: np.ndarray, codes: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of the candidates those that have enough of the item's words near by; others need more edits than allowed."""
        by_hash = np.argsort(hashes)
        known = hashes[by_hash]
        mark = np.zeros(len(hashes), bool)
        kept = np.zeros(len(rows), bool)
        order = np.argsort(rows[:, 1], kind="stable")
        firsts = np.flatnonzero(np.diff(rows[order, 1], prepend=-1))
        for a, b in zip(firsts, [*firsts[1:], len(order)], strict=True):
            item = int(rows[order[a], 1])
            pattern, most = np.array(self.item_words[item], np.uint64), self.most_edits[item]
            own = by_hash[_matches(known, pattern)[1]]  # several written forms of a word have one hash
            mark[own] = True
            width = len(pattern) + 2 * most
            for some in np.array_split(order[a:b], 1 + (b - a) * width // REGION_WORDS):
                text, begin = rows[some, 0], rows[some, 2]
                place = (begin - most)[:, None] + np.arange(width)
                inside = (place >= starts[text][:, None]) & (place < starts[text + 1][:, None])
                words = codes[np.clip(place, 0, len(codes) - 1)]
                kept[some] = (mark[words] & inside).sum(axis=1) >= len(pattern) - most
            mark[own] = False
        return rows[kept]

    def leaks(self, texts: pa.Array) -> dict[int, list[dict]]:
        """For each text that contains items: where."""
        codes, hashes, starts = word_hashes(texts)
        out: dict[int, list[dict]] = {}
        done: tuple[int, int, int] = (-1, -1, -1)  # text, item, end of its last run
        rows = self.candidates(codes, hashes, starts)
        for text, item, begin in self._likely(rows, codes, hashes, starts).tolist() if len(rows) else []:
            pattern, most = self.item_words[item], self.most_edits[item]
            if done[:2] == (text, item) and begin + most < done[2]:
                continue
            low = max(int(starts[text]), begin - most, done[2] if done[:2] == (text, item) else 0)
            high = min(int(starts[text + 1]), begin + len(pattern) + most)
            if run := best_run(pattern, hashes[codes[low:high]].tolist(), most):
                distance, first, end = run
                done = (text, item, low + end)
                out.setdefault(text, []).append(
                    {
                        "item": self.item_ids[item],
                        "first_word": low + first - int(starts[text]),
                        "n_words": end - first,
                        "distance": distance,
                    }
                )
        return out


def _run_signatures(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """A number for each run of so many words."""
    n = max(0, len(hashes) - n_words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(n_words):
        out = out * _FOLD + hashes[i : i + n]
    return mixed(out)


def _matches(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``wanted`` and in the sorted ``known`` that are equal, all pairs of them."""
    low = np.searchsorted(known, wanted, side="left")
    high = np.searchsorted(known, wanted, side="right")
    hit = np.flatnonzero(high > low)
    low, high = low[hit], high[hit]
    return np.repeat(hit, high - low), np.repeat(low, high - low) + _counting(high - low)


def _counting(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _indexes(items: DataFrame, id_col: str, text_col: str, similarity: float, recall: float) -> Iterator[Index]:
    """An index for each block of items; a block is all that the driver holds of them at a time."""
    own = items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = own.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(-(-size["items"] // BLOCK_ITEMS), -(-size["bytes"] // BLOCK_BYTES))
    for block in range(n_blocks):
        rows = own.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).orderBy("id", "text").toArrow()
        if rows.num_rows:
            yield Index.of(rows.column("id").to_pylist(), rows.column("text").to_pylist(), similarity, recall)


def _judged(docs: DataFrame, index: Index, text_col: str, out_col: str) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, LEAK)])
    place = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in LEAK.elementType.fields]))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches, text_col):
            found = sent.value.leaks(pc.fill_null(step.column(place).cast(pa.string()), ""))
            column = pa.array([found.get(i, []) for i in range(step.num_rows)], kind)
            yield pa.RecordBatch.from_arrays([*step.columns, column], [*step.schema.names, out_col])

    return docs.mapInArrow(judged, schema)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """One row per item that a document contains: id, item, first_word, n_words, distance."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], T.StructType([own.schema["id"], *LEAK.elementType.fields]))
    for index in _indexes(items, item_col, item_text_col, similarity, recall):
        found = _judged(own, index, "text", "leaks").select("id", F.explode("leaks").alias("leak"))
        out = out.unionByName(found.select("id", "leak.*"))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaking(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    leaks = unused("leaks", docs)
    for index in _indexes(items, item_col, item_text_col, similarity, recall):
        docs = _judged(docs, index, text_col, leaks).where(F.size(leaks) == 0).drop(leaks)
    return docs
