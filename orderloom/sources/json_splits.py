"""Records of large JSON pages, read in splits and written as one record a line.

A page is one value, so a reader of whole files gives it to one task. Here the text is cut at every closing brace,
which can be done from any byte on. What a piece means depends on whether it begins inside a string and on what is open
there. Every split is read once under both assumptions about the string; it then closes some brackets that
were open before and leaves some open. Chained in file order on the driver (a few letters a split), that tells what is
open where each split begins, and each split can be cut into records. A record that crosses splits is put together
from its parts.

Most pieces are a flat record: one that opens an object outside strings, in which nothing else is open at its closing
brace. They are found a batch at a time. A run of them does what one of them does, so they are not looked into one by one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.session import scratch_path
from orderloom.sources.base import ExtractionError
from orderloom.sources.splits import files, placed

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
# What is open is a text of letters: an object, the list of records, any other list.
_OBJECT, _RECORDS, _LIST = "OrL"
_KEY = "\x01"
_TOKEN = re.compile(rf"{_KEY}\s*:\s*\[|[\[\]{{]")


def tokens(piece: str, in_string: bool, key: str | None) -> tuple[list[tuple[int, str]], bool]:
    """Where brackets open or close in a piece of text without closing braces, and whether it ends inside a string."""
    if "\\" not in piece and (key is None or f'"{key}"' not in piece):
        # Most pieces have no escapes and open one flat object at most: counting quotes is enough.
        parts = piece.split('"')
        outside = "".join(parts[in_string::2])
        ends_inside = (len(parts) - 1 + in_string) % 2 == 1
        n = outside.count("{")
        if "[" not in outside and "]" not in outside and (not n or n == piece.count("{") == 1):
            return ([(piece.index("{"), _OBJECT)] if n else []), ends_inside
    at = 0
    if in_string:
        rest = _REST_OF_STRING.match(piece)
        if not rest:
            return [], True
        at = rest.end()
    if '"' in piece[at:]:
        written = json.dumps(key) if key is not None else None

        def blank(found: re.Match) -> str:
            text = found[0]
            is_key = key is not None and (text == written or "\\" in text and _same(text, key))
            return (_KEY if is_key else " ") * len(text)

        plain = _STRING.sub(blank, piece[at:])
    else:
        plain = piece[at:]
    opened = plain.find('"')
    if opened >= 0:
        plain = plain[:opened]
    found = []
    for token in _TOKEN.finditer(plain):
        kind = {"{": _OBJECT, "[": _LIST, "]": "]"}.get(token[0], _RECORDS)
        found.append((at + token.end() - 1, kind))
    return found, opened >= 0


def flat(pieces: pa.Array, key: str | None) -> np.ndarray:
    """Which pieces open one object before their first string and end outside strings if they begin outside (and inside
    if they begin inside): with its closing brace such a piece leaves all as it was."""

    def number(of: str) -> np.ndarray:
        return pc.count_substring(pieces, of).to_numpy(zero_copy_only=False)

    def place(of: str) -> np.ndarray:
        return pc.find_substring(pieces, of).to_numpy(zero_copy_only=False)

    quotes, first = number('"'), place('"')
    found = (number("{") == 1) & (quotes % 2 == 0) & ((quotes == 0) | (place("{") < first))
    for other in ("[", "]", "\\", *([f'"{key}"'] if key is not None else [])):
        found &= place(other) < 0
    return found


def _same(text: str, key: str) -> bool:
    try:
        return json.loads(text) == key
    except ValueError:
        return False


def close(opened: str, closing: str) -> str | None:
    """What is open after a closing bracket; None if it does not fit."""
    fits = opened and (opened[-1] == _OBJECT) == (closing == "}")
    return opened[:-1] if fits else None


def _reduced(closed: str, opened: str, closing: str) -> tuple[str, str] | None:
    """What a text closes of before and leaves open, after one more closing bracket."""
    if not opened:
        return closed + closing, ""
    left = close(opened, closing)
    return None if left is None else (closed, left)


_SUMMARY = (
    "file long, start long, bytes long, n long, "
    "in0 boolean, closed0 string, opened0 string, in1 boolean, closed1 string, opened1 string"
)


def _summaries(key: str | None):
    """One row per split: what it does under both assumptions. Its last closing brace is left to the chain."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, states, n, size = [], None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            of, since, pieces, lengths = batch.columns
            flats, of, since = flat(pieces, key), of.to_numpy(), since.to_numpy()
            # Of a run of flat pieces of a split the first one stands for all.
            repeats = np.zeros(len(flats), bool)
            repeats[1:] = flats[1:] & flats[:-1] & (of[1:] == of[:-1]) & (since[1:] == since[:-1])
            looked_at = np.flatnonzero(~repeats)
            numbers = np.diff(np.append(looked_at, len(flats)))
            sizes = np.add.reduceat(lengths.to_numpy(), looked_at)
            seen = zip(
                of[looked_at].tolist(), since[looked_at].tolist(), pieces.take(pa.array(looked_at)).to_pylist(), sizes.tolist(),
                numbers.tolist(), strict=True,
            )
            for file, start, piece, length, count in seen:
                if (file, start) != now:
                    if now:
                        done.append((now, size, n, states))
                    now, states, n, size = (file, start), [(False, "", ""), (True, "", "")], 0, 0
                if n:
                    states = [s and (s if s[0] else _after(s, "}")) for s in states]
                states = [s and _piece_after(s, piece, key) for s in states]
                n, size = n + count, size + length
        if now:
            done.append((now, size, n, states))
        rows = [(*k, size, n, *(x for s in states for x in (s or (None, None, None)))) for k, size, n, states in done]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 10
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.string(), pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in _SUMMARY.split(", ")]
        )

    return summed


def _after(state: tuple[bool, str, str], closing: str) -> tuple[bool, str, str] | None:
    reduced = _reduced(*state[1:], closing)
    return reduced and (state[0], *reduced)


def _piece_after(state: tuple[bool, str, str], piece: str, key: str | None) -> tuple[bool, str, str] | None:
    found, in_string = tokens(piece, state[0], key)
    for _, kind in found:
        state = _after(state, "]") if kind == "]" else (state[0], state[1], state[2] + kind)
        if state is None:
            return None
    return (in_string, *state[1:])


def _inside(opened: str, targets: tuple[str, ...]) -> str | None:
    """What is open around the record that is open, if one is."""
    return next((t for t in targets if opened.startswith(t + _OBJECT)), None)


def _chained(spark: SparkSession, path: str, pieces: DataFrame, key: str | None, targets: tuple[str, ...]) -> list[tuple]:
    """The splits in file order, with what is open where each begins."""
    sized = pieces.select("_file", "_start", "piece", F.octet_length("piece").cast("long").alias("length"))
    found = sized.mapInArrow(_summaries(key), _SUMMARY).collect()
    known = files(spark, path)
    ends = {}
    for r in found:
        total = ends.setdefault(r.file, [0, max(s.start for s in found if s.file == r.file)])
        total[0] += r.bytes + r.n
    plan, file, opened, in_string, owner = [], None, "", False, None

    def check_end():
        if file is not None and (opened or in_string):
            raise ExtractionError(f"{known[file][0]} is a broken page")

    for number, split in enumerate(sorted(found, key=lambda r: (known[r.file][0], r.start))):
        if split.file != file:
            check_end()
            file, opened, in_string = split.file, "", False
        around = _inside(opened, targets)
        plan.append((number, file, split.start, opened, in_string, owner if around is not None else None))
        now, closed, left = (split.in1, split.closed1, split.opened1) if in_string else (split.in0, split.closed0, split.opened0)
        size, last = ends[file]
        if now is not None and not now and (split.start != last or size == known[file][1]):
            closed, left = _reduced(closed, left, "}") or (None, None)
        if closed is None:
            raise ExtractionError(f"{known[file][0]} is a broken page")
        depth = len(opened)
        for closing in closed:
            opened = close(opened, closing)
            if opened is None:
                raise ExtractionError(f"{known[file][0]} is a broken page")
        ended = around is None or depth - len(closed) <= len(around)
        opened, in_string = opened + left, now
        if ended and _inside(opened, targets) is not None:
            owner = number
    check_end()
    return plan


def _records(key: str | None, targets: tuple[str, ...]):
    """The records of each split: whole ones (of null), and parts of those that cross splits."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, opened, in_string, around, parts, is_rest, owner, out = None, "", False, None, [], False, None, []

        def finish(whole: bool):
            text = "".join(parts).replace("\n", " ").replace("\r", " ")
            if whole and not is_rest:
                out.append((None, None, text))
            else:
                out.append((owner if is_rest else number, number, text))
            parts.clear()

        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), flat(batch.column("piece"), key).tolist(), strict=True)
            for split, before, string, of, piece, is_flat in rows:
                if split != number:
                    if around is not None:
                        finish(False)
                    number, opened, in_string, owner = split, before, string, of
                    around = _inside(opened, targets)
                    is_rest = around is not None
                if is_flat and around is None and not in_string and opened in targets:
                    text = piece[piece.index("{") :] + "}"
                    out.append((None, None, text.replace("\n", " ").replace("\r", " ")))
                    continue
                found, in_string = tokens(piece, in_string, key)
                begin = 0
                for at, kind in found:
                    if kind == "]":
                        opened = opened[:-1]
                        continue
                    if kind == _OBJECT and around is None and opened in targets:
                        around, begin, is_rest = opened, at, False
                    opened += kind
                if around is not None:
                    parts.append(piece[begin:] + "}")
                if not in_string:
                    opened = opened[:-1]
                    if around is not None and len(opened) == len(around):
                        finish(True)
                        around = None
            yield _batch(out)
            out.clear()
        if around is not None:
            finish(False)
        yield _batch(out)

    return cut


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 3
    kinds = (pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["record_of", "number", "text"]
    )


def as_lines(spark: SparkSession, path: str, key: str | None) -> str:
    """A folder with one record a line: those in the list under the key, or the pages' elements and lone objects."""
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(F.col("value").alias("piece"), *(c.alias(n) for n, c in placed(raw).items()))
    targets = ("", _LIST) if key is None else (_OBJECT + _RECORDS,)
    chained = _chained(spark, path, pieces, key, targets)
    plan = spark.createDataFrame(
        chained, "number int, _of long, _from long, opened string, in_string boolean, owner int"
    )
    here = (F.col("_file") == F.col("_of")) & (F.col("_start") == F.col("_from"))
    located = pieces.join(F.broadcast(plan), here).select("number", "opened", "in_string", "owner", "piece")
    found = located.mapInArrow(_records(key, targets), "record_of int, number int, text string")
    # Both are written by the one pass that cuts the records: whole ones as they are, parts after two numbers.
    is_part = F.col("record_of").isNotNull()
    line = F.when(is_part, F.concat_ws(" ", "record_of", "number", "text")).otherwise(F.col("text"))
    folder = scratch_path(spark, "records")
    found.select(line.alias("value"), is_part.cast("int").alias("part")).write.partitionBy("part").text(folder)
    lines = f"{folder}/part=0"
    written = spark.read.text(f"{folder}/part=1") if any(owner is not None for *_, owner in chained) else None
    if written is None:
        # The folder is there even if no page has a record.
        spark.createDataFrame([], "value string").write.mode("append").text(lines)
        return lines
    split = F.split("value", " ", 3)
    numbered = written.select(split[0].alias("record_of"), split[1].cast("int").alias("number"), split[2].alias("text"))
    parts = numbered.groupBy("record_of").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("parts"))
    crossing = parts.select(F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    crossing.write.mode("append").text(lines)
    return lines
