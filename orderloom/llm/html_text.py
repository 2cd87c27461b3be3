"""Main text of web pages: markup names what it can, and host-wide suffix arrays find the boilerplate.

A page is cut into blocks. Blocks inside an ``article`` or ``main`` element are its main text; blocks
inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments are not, whatever
contains them. All text outside the main element is the page's loose text. A class or id rules an element out only if
its last word says what the element is, never the page or its outermost main element, and not what contains the
only main text of a page; where names would leave a page without text, the suffix array decides on what they rule out.

For each host the token streams of the loose texts are concatenated and their suffixes ranked by prefix
doubling, up to ``RUN`` tokens (a power of two): suffixes of equal rank begin with the same run of that
many tokens, so the runs that occur on two distinct pages are known, and their union is every repeated
substring of at least that length. What they cover is boilerplate. A page without a main element keeps
the runs of its loose text that nothing covers and no markup rules out. So does a page whose main element is a mere
teaser, with less than ``TEASER`` of the words of those runs: its text is both, in page order. In other pages
the boilerplate found is counted. The article itself is never cut: a passage that several pages of a host quote
belongs to each of them. Pages with the same loose text count as one page, so a mirrored page is not its own
boilerplate.

A host with more than its share of all pages or bytes is cut into sections, each with a suffix array of its own.
The runs that occur in two sections, on pages of different content, are found by their hashes, one row per section and
run, and are added to what each section covers; the result is that of one array over the host.

Text of a block: character references decoded, white space runs as one space, trimmed. Blocks without text
are dropped, the others joined by one line feed.

Defined results: a null html is empty and gives an empty text; a null url or one without host belongs to
the host ''; a tag that is never closed ends with the element around it; a script, style or comment that is
never closed hides the rest of the page; rows that repeat an identifier are extracted each; an empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import shuffle_partitions, stored
from orderloom.llm.words import in_steps, mixed

#: Tokens of a repeated run, a power of two.
RUN = 8
#: A host is cut into sections from this share of an average partition's pages or bytes of html, and at least so many.
HOT_SHARE, HOT_PAGES, HOT_BYTES = 0.25, 128, 32 << 20
#: A main element with fewer words than this share of what else the page alone has is a teaser.
TEASER = 0.2

# Elements by what they are in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
HIDDEN = frozenset("script style title textarea noscript template iframe".split())
ASIDE = frozenset("nav header footer aside form menu dialog button select svg canvas object audio video".split())
#: Those of them that may stand in a sentence: they are skipped and do not end it.
SKIPPED = frozenset("button select svg canvas object audio video".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus respond reply "
    "share sharing social related recommended pagination pager login signup widget widgets toolbar".split()
)
#: Words of a class or id that is about what the element contains.
ABOUT_OTHERS = frozenset("has have no not with without".split())
#: How a block is ruled out.
BY_NAME, SURE = 1, 2

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z0-9]+")


def _names_aside(value: str) -> bool:
    """Whether a class or id says what the element is: by its last word, unless it says what it has or has not."""
    return any(
        words[-1] in ASIDE_NAMES and ABOUT_OTHERS.isdisjoint(words) for name in value.split() if (words := _NAME.findall(name))
    )


def _is_aside(tag: str, attributes: str) -> int:
    """SURE by tag, role or a hidden attribute, BY_NAME by class or id, otherwise 0."""
    if tag in ASIDE:
        return SURE
    if not attributes:
        return 0
    named = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role" and value in ASIDE_ROLES:
            return SURE
        if name.lower() in ("class", "id") and _names_aside(value):
            named = BY_NAME
    return SURE if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) else named


def blocks(html: str, lifted: bool = False) -> list[tuple[str, bool, int]]:
    """(text, whether in a main element, how ruled out) of each block with text, in page order.

    lifted: a main element is not ruled out by the names of what contains it.
    """
    out: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: tag, in main, ruled out
    text: list[str] = []
    main, aside, skipped = False, 0, 0
    at = 0

    def flush() -> None:
        if skipped:
            return
        if joined := " ".join(unescape("".join(text)).split()):
            out.append((joined, main, aside))
        text.clear()

    def enter(state: tuple[str, bool, int]) -> None:
        nonlocal main, aside
        if state[1:] != (main, aside):
            flush()
        stack.append(state)
        main, aside = state[1:]

    def leave(n: int) -> None:
        nonlocal main, aside, skipped
        state = stack[n - 1][1:] if n else (False, 0)
        skipped = sum(tag in SKIPPED for tag, *_ in stack[:n])
        if state != (main, aside):
            flush()
        del stack[n:]
        main, aside = state

    while found := _PIECE.search(html, at):
        if not skipped:
            text.append(html[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag or tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
                if tag == "hr":
                    flush()
            continue
        if found[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag not in INLINE | SKIPPED:
                flush()
            elif tag in INLINE and place is not None and any(s[0] not in INLINE | SKIPPED for s in stack[place:]):
                continue  # an inline element does not end the blocks inside it
            if place is not None:
                was_skipped = skipped
                leave(place)
                if was_skipped and not skipped and tag not in SKIPPED:
                    flush()  # what was skipped was never closed
            continue
        if tag in HIDDEN:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in SKIPPED:
            if not found[3].rstrip().endswith("/"):
                skipped += 1
                stack.append((tag, main, aside))
            continue
        if tag not in INLINE:
            flush()
            # A new block ends an open paragraph, and an item the item before it.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] == tag and tag in ("li", "option", "tr", "td", "th", "dt", "dd"):
                    leave(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        attributes = found[3]
        if attributes.rstrip().endswith("/") and tag not in INLINE | MAIN:
            continue
        named = tag in MAIN or 'role="main"' in attributes
        own = _is_aside(tag, attributes)
        if own == BY_NAME and (tag in ("html", "body") or named and not main):
            own = 0  # the page or its main element, whatever its name
        ruled_out = max(0 if lifted and named and not main and aside == BY_NAME else aside, own)
        if tag in HEADINGS and main and ruled_out and not any(s[2] and s[0] != "header" for s in stack):
            ruled_out = 0  # the heading of an article may stand in a header of its own
        enter((tag, main or named, ruled_out))
    tail = html[at:]
    if not skipped:
        text.append(tail[: tail.rfind("<")] if re.search(r"<[/a-zA-Z!?][^>]*\Z", tail) else tail)
    skipped = 0
    flush()
    return out


#: Kinds of blocks: of the main text, loose, loose and ruled out by markup.
IN_MAIN, LOOSE, OUT = 0, 1, 2


def parsed(html: str) -> tuple[list[str], list[int]]:
    """The blocks of a page that may belong to its text or to boilerplate, and their kinds."""
    found = blocks(html)
    has_main = any(main and not aside for _, main, aside in found)
    if not has_main and any(main and aside == BY_NAME for _, main, aside in found):
        found = blocks(html, lifted=True)
        has_main = any(main and not aside for _, main, aside in found)
    # What is ruled out within a main element is neither.
    found = [f for f in found if not (f[1] and f[2])]
    # Names alone do not leave a page empty: the runs of its host decide.
    least = SURE if not has_main and all(aside for _, main, aside in found if not main) else BY_NAME
    kinds = [IN_MAIN if main else OUT if aside >= least else LOOSE for _, main, aside in found]
    return [text for text, *_ in found], kinds


def loose_blocks(texts: list[str], kinds: list[int]) -> list[str]:
    return [t for t, kind in zip(texts, kinds, strict=True) if kind != IN_MAIN]


# Suffix arrays ------------------------------------------------------------------------------------


class Streams:
    """The loose token streams of some pages of a host, concatenated.

    covered: for each token whether a repeated run covers it.
    """

    def __init__(self, pages: list[list[str]]):
        self.tokens = [[block.split(" ") for block in page] for page in pages]
        flat = [t for page in self.tokens for block in page for t in block]
        self.lengths = np.array([sum(map(len, page)) for page in self.tokens], np.int64)
        self.page = np.repeat(np.arange(len(pages)), self.lengths)
        same: dict[tuple, int] = {}
        content = [same.setdefault(tuple(page), len(same)) for page in pages]
        self.content = np.array(content, np.int64)[self.page]
        vocabulary: dict[str, int] = {}
        self.code = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in flat], np.int64)
        hashes = np.array([xxhash.xxh64_intdigest(t) for t in vocabulary], np.uint64)
        n = len(flat)
        # Runs do not cross the end of a page.
        ends = np.cumsum(self.lengths)
        self.start = np.flatnonzero(np.arange(n) + RUN <= ends[self.page]) if n else np.zeros(0, np.int64)
        self.covered = np.zeros(n, bool)
        self.run_hash = np.zeros(len(self.start), np.uint64)
        for k in range(RUN if len(self.start) else 0):
            self.run_hash = mixed(self.run_hash * np.uint64(3) + hashes[self.code[self.start + k]])
        self._cover(self._repeated())

    def _repeated(self) -> np.ndarray:
        """Of the starts: whether the run there occurs on two distinct pages, by suffix ranks."""
        if not len(self.start):
            return np.zeros(0, bool)
        rank, width = self.code, 1
        while width < RUN:
            after = np.append(rank[width:], np.full(min(width, len(rank)), -1))[: len(rank)]
            rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1]
            width *= 2
        order = np.lexsort((self.content[self.start], rank[self.start]))
        run, content = rank[self.start][order], self.content[self.start][order]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        last = np.append(first[1:], len(run)) - 1
        several = content[first] != content[last]
        out = np.zeros(len(order), bool)
        out[order] = np.repeat(several, last - first + 1)
        return out

    def _cover(self, which: np.ndarray) -> None:
        change = np.zeros(len(self.covered) + 1, np.int64)
        np.add.at(change, self.start[which], 1)
        np.add.at(change, self.start[which] + RUN, -1)
        self.covered |= np.cumsum(change)[:-1] > 0

    def cover_hashes(self, hashes: np.ndarray) -> None:
        """Covers the runs with these hashes too."""
        if len(hashes) and len(self.start):
            self._cover(np.isin(self.run_hash, hashes))

    def kept(self) -> Iterator[tuple[list[str], int]]:
        """Per page: what is not covered of each block, and the number of covered tokens."""
        at = 0
        for page in self.tokens:
            left, begin = [], at
            for block in page:
                own = self.covered[at : at + len(block)]
                left.append(" ".join(t for t, c in zip(block, own.tolist(), strict=True) if not c))
                at += len(block)
            yield left, int(self.covered[begin:at].sum())


# Spark --------------------------------------------------------------------------------------------

_PARSED = "id {id}, url string, host string, section int, n_sections int, texts array<string>, kinds array<int>"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


def _parsed(pages: DataFrame) -> DataFrame:
    """Of (id, url, html, host, section, n_sections) rows: the same with parsed blocks."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches, "html"):
            rows = [parsed(h or "") for h in step.column("html").to_pylist()]
            names = ["id", "url", "host", "section", "n_sections"]
            columns = [step.column(c) for c in names]
            columns += [pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "texts", "kinds"])

    return pages.mapInArrow(steps, _PARSED.format(id=pages.schema["id"].dataType.simpleString()))


def _loose(table: pa.Table) -> list[list[str]]:
    return [loose_blocks(*page) for page in zip(table.column("texts").to_pylist(), table.column("kinds").to_pylist(), strict=True)]


def _run_hashes(table: pa.Table) -> pa.Table:
    """The different runs of a section, as hashes, each with the least and greatest hash of a page content that has it."""
    pages = table.column("loose").to_pylist()
    streams = Streams(pages)
    contents = np.array([xxhash.xxh64_intdigest("\n".join(page)) for page in pages], np.uint64).view(np.int64)
    run, content = streams.run_hash.view(np.int64), contents[streams.page[streams.start]]
    order = np.lexsort((content, run))
    runs, first, counts = np.unique(run[order], return_index=True, return_counts=True)
    lo, hi = content[order][first], content[order][first + counts - 1]
    n = len(runs)
    columns = {"host": pa.repeat(table.column("host")[0], n), "section": pa.repeat(table.column("section")[0], n)}
    return pa.table(columns | {"run": pa.array(runs), "lo": pa.array(lo), "hi": pa.array(hi)})


def _chosen(left: list[str], texts: list[str], kinds: list[int]) -> list[str]:
    """The blocks of a page's text; ``left`` has what of its loose blocks nothing covers."""
    rest = iter(left)
    shown = [text if kind == IN_MAIN else next(rest) for text, kind in zip(texts, kinds, strict=True)]
    n_words = [0, 0, 0]
    for text, kind in zip(shown, kinds, strict=True):
        n_words[kind] += text.count(" ") + 1 if text else 0
    is_teaser = n_words[IN_MAIN] < TEASER * n_words[LOOSE]
    wanted = (IN_MAIN, LOOSE) if is_teaser or IN_MAIN not in kinds else (IN_MAIN,)
    return [text for text, kind in zip(shown, kinds, strict=True) if text and kind in wanted]


def _resolved(table: pa.Table, runs: pa.Table) -> pa.Table:
    streams = Streams(_loose(table))
    streams.cover_hashes(runs.column("run").to_numpy().view(np.uint64))
    texts, counts = [], []
    pages = (table.column(c).to_pylist() for c in ("texts", "kinds"))
    for (left, n), blocks_of, kinds in zip(streams.kept(), *pages, strict=True):
        texts.append("\n".join(_chosen(left, blocks_of, kinds)))
        counts.append(n)
    return pa.table(
        {"id": table.column("id"), "url": table.column("url"), "text": texts, "n_boilerplate": pa.array(counts, pa.int64())}
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_boilerplate (words of the loose text found on other pages)."""
    own = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    ).withColumn("host", host_of(F.col("url")))
    spark = pages.sparkSession
    size = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes")).first()
    share = HOT_SHARE / shuffle_partitions(spark)
    most_pages, most_bytes = max(HOT_PAGES, int(size["n"] * share)), max(HOT_BYTES, int((size["bytes"] or 0) * share))
    # At most twice as many hosts as partitions / HOT_SHARE have that much: few enough to broadcast.
    by_host = own.groupBy("host").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / most_pages, F.col("bytes") / most_bytes)).cast("int")
    hot = by_host.select("host", parts.alias("parts")).where("parts > 1")
    sections = (
        own.join(F.broadcast(stored(hot, "hot-hosts")), "host", "left")
        .withColumn("n_sections", F.coalesce("parts", F.lit(1)))
        .withColumn("section", F.pmod(F.xxhash64("id", "url"), F.col("n_sections")).cast("int"))
        .select("id", "url", "html", "host", "section", "n_sections")
    )
    # Pages of cut hosts are parsed twice: their blocks take more room than the time is worth.
    cut = _parsed(sections.where("n_sections > 1"))
    loose = F.filter("texts", lambda _, i: F.get("kinds", i) != IN_MAIN)
    runs = (
        cut.select("host", "section", loose.alias("loose"))
        .groupBy("host", "section")
        .applyInArrow(_run_hashes, "host string, section int, run long, lo long, hi long")
    )
    runs = stored(runs, "section-runs")
    of_run = runs.groupBy("host", "run").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    shared = stored(of_run.where("n > 1 and lo <> hi").select("host", "run"), "shared-runs")
    known = runs.join(shared, ["host", "run"]).select("host", "section", "run")
    pages_of, runs_of = (df.groupBy("host", "section") for df in (_parsed(sections), known))
    id_type = own.schema["id"].dataType.simpleString()
    columns = f"id {id_type}, url string, text string, n_boilerplate long"
    out = pages_of.cogroup(runs_of).applyInArrow(_resolved, columns)
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
