r"""Secrets found through a trigram index.

From the pattern of each rule a Boolean query over trigrams is derived: what every match must contain,
in lower case. Each block of documents gets an inverted index (trigram to the block's documents)
of the trigrams that any query names; posting lists are intersected and united as the query says, and
the regular expression runs only over the documents that are left. A rule without mandatory trigrams
runs over all. Blocks are independent, so there is no shuffle and a lost executor costs its blocks.

The derivation: a literal string gives its trigrams, a choice gives "or", a sequence "and"; short
alternatives are multiplied out so that strings may cross the border of a group. Anything else
breaks the string.

Defined results: a null text is empty and has no findings; rows that repeat an identifier are scanned
each; an empty table gives an empty table; other columns are passed on, but one named as the
result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orderloom.llm.words import in_steps


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern whose group has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The base rules, then the added ones (public formats of issued keys).
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
ADDED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = (*BASE_RULES, *ADDED_RULES)

FINDING = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)

# Boolean queries ----------------------------------------------------------------------------------

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple
#: Alternatives that are multiplied out; beyond this many a group breaks the string instead.
MOST_STRINGS = 64


def _all(parts: Sequence[Query]) -> Query:
    parts = tuple(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: Sequence[Query]) -> Query:
    parts = tuple(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]) -> Query:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _literals(items) -> set[str] | None:
    """The characters of a small set of plain ASCII characters, in lower case."""
    if len(items) <= 8 and all(code is op.LITERAL and value < 128 for code, value in items):
        return {chr(value).lower() for _, value in items}
    return None


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """(all strings it can match, or None if unknown or too many; what any match must contain)."""
    strings: set[str] | None
    tail, needs, complete = {""}, [], True
    for code, value in parsed:
        strings, need = None, True
        if code is op.LITERAL:
            strings = _literals([(code, value)])
        elif code is op.IN:
            strings = _literals(value)
        elif code is op.AT:
            strings = {""}
        elif code is op.SUBPATTERN:
            strings, need = _walk(value[-1])
        elif code is op.BRANCH:
            sides = [_walk(side) for side in value[1]]
            if all(known is not None for known, _ in sides):
                strings = set().union(*(known for known, _ in sides))
            else:
                need = _any([n if known is None else _of_strings(known) for known, n in sides])
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = value
            known, body_need = _walk(body)
            if known is not None and (low, high) == (0, 1):
                strings = known | {""}
            elif low:
                need = body_need if known is None else _of_strings(known)
        needs.append(need)
        if strings is not None and len(tail) * len(strings) <= MOST_STRINGS:
            tail = {a + b for a in tail for b in strings}
            continue
        complete = False
        needs.append(_of_strings(tail))
        tail = {""}
        if strings is not None:
            needs.append(_of_strings(strings))
    return (tail, True) if complete else (None, _all([*needs, _of_strings(tail)]))


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of any match must contain; True if nothing can be said."""
    strings, need = _walk(_parser.parse(pattern, re.ASCII))
    return need if strings is None else _of_strings(strings)


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*(trigrams_of(q) for q in query[1]))


def matching(query: Query, postings: dict[str, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """The sorted documents that satisfy the query, from posting lists."""
    if query is True:
        return everything
    if isinstance(query, str):
        return postings[query]
    lists = sorted((matching(q, postings, everything) for q in query[1]), key=len)
    out = lists[0]
    for other in lists[1:]:
        out = np.intersect1d(out, other, True) if query[0] == "and" else np.union1d(out, other)
    return out


# Index of a block ---------------------------------------------------------------------------------


class TrigramIndex:
    """Posting lists of chosen trigrams over a block of texts."""

    def __init__(self, trigrams: set[str]):
        self.trigrams = sorted(trigrams)
        self.slot = np.zeros(1 << 24, np.uint8)  # 0: not asked for
        if len(self.trigrams) > 255:
            raise ValueError("at most 255 different trigrams per index")
        for i, t in enumerate(self.trigrams):
            self.slot[self._code(np.frombuffer(t.encode(), np.uint8))] = i + 1
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    @staticmethod
    def _code(data: np.ndarray) -> np.ndarray:
        wide = data.astype(np.uint32)
        return (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]

    def postings(self, texts: pa.Array) -> dict[str, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        if len(data) < 3:
            return {t: np.zeros(0, np.int64) for t in self.trigrams}
        slots = self.slot[self._code(self.lower[data])]
        at = np.flatnonzero(slots)
        slots = slots[at]
        row = np.searchsorted(offsets, at + offsets[0], side="right") - 1
        inside = at + offsets[0] + 3 <= offsets[row + 1]  # not across the end of a text
        slots, row = slots[inside], row[inside]
        order = np.argsort(slots, kind="stable")
        slots, row = slots[order], row[order]
        cuts = np.searchsorted(slots, np.arange(1, len(self.trigrams) + 2))
        return {t: np.unique(row[cuts[i] : cuts[i + 1]]) for i, t in enumerate(self.trigrams)}


def find(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches, without those that are too short; offsets in code points."""
    return [
        (rule.kind, m.start(), m.end())
        for m in compiled.finditer(text)
        if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]


def _scanning(rule: Rule) -> str:
    """The pattern, or one that finds the same long runs without stopping at short ones."""
    run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{run[1]}{{{rule.least},}}" if run and rule.least and rule.group == 0 else rule.pattern


def scan(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", out_col: str = "findings"
) -> DataFrame:
    """``docs`` with an array of findings (kind, start, end), by start, then in the order of the rules."""
    rules = tuple(rules)
    docs = docs.drop(out_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(FINDING))])
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = set().union(*(trigrams_of(q) for q in queries))
    place = docs.columns.index(text_col)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(wanted)
        compiled = [re.compile(_scanning(r), re.ASCII) for r in rules]
        order = {r.kind: i for i, r in enumerate(rules)}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for step in in_steps(batches, text_col):
            texts = pc.fill_null(step.column(place).cast(pa.string()), "")
            postings, everything = index.postings(texts), np.arange(len(texts))
            found: dict[int, list] = {}
            for rule, pattern, query in zip(rules, compiled, queries, strict=True):
                for row in matching(query, postings, everything).tolist():
                    if hits := find(rule, pattern, texts[row].as_py()):
                        found.setdefault(row, []).extend(hits)
            column = [
                [{"kind": k, "start": s, "end": e} for k, s, e in sorted(hits, key=lambda h: (h[1], order[h[0]]))]
                for hits in (found.get(row, []) for row in range(len(texts)))
            ]
            yield pa.RecordBatch.from_arrays(
                [*step.columns, pa.array(column, kind)], [*step.schema.names, out_col]
            )

    return docs.mapInArrow(scanned, schema)
