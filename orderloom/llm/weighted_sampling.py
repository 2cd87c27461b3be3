"""Document fingerprints by consistent weighted sampling (Ioffe, 2010), in DataFrame functions only.

A text's weighted terms are its words, each weighing as often as it occurs. For sample number l a term k has two
gamma variates r, c ~ Gamma(2, 1) and a uniform b, all fixed by a hash of (k, l). With weight w,

    t = floor(ln w / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r,

and the term with the least a is the sample, together with its t. Two texts share a sample with the
probability of their generalised Jaccard similarity: the sum over terms of the smaller weight, divided by that
of the larger one. A fingerprint has SAMPLES samples, so the share of equal ones estimates the similarity with a
standard deviation of at most 0.5 / sqrt(SAMPLES).

Most terms are ruled out without a logarithm. As ln y <= ln w and c >= 2 (1 - q) / (1 + q), where c = -ln q, no a is
below exp(-r) * 2 (1 - q) / (1 + q) / w, and exp(-r) is the product that r is the logarithm of. The least a of
a text of W words is exponential with mean 1 / W, so it is above LIKELY / W hardly ever; terms that cannot be below
that are skipped. If the least a found is below it, skipping changed nothing; documents in which it is not
are done again with all their terms.

The value of a names (k, t), so the least a is all that is kept of a sample: 16 bits of its hash, from 1 to 65535;
unequal samples agree by chance with probability 2**-16. Zero stands for a text without words.

A text's words are hashed, sorted and counted within its row, so no word is shuffled; up to two texts of a row (a
document and an edited version) share the variates of a term. Samples are reduced to minima by hash aggregation in
the partitioning that the rows already have. Each task holds the minima of its documents, never a document's
samples of all terms.

Defined results: a null text is empty; a text without words has a fingerprint of zeros, which is like others without words
only; rows that repeat identifier and text are one document, returned as often as it occurs; documents of one identifier
follow each other in the order of their texts' hashes, those without identifier come last; an empty table
gives an empty table; other columns are not read, whatever their names. Identifiers are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import SPACES, stored, text_of

SAMPLES = 64
#: Samples that one row of the aggregation holds: few enough for the compiled method to stay small.
LANE = 4
#: Least values are looked for below so many times their mean. A sample is beyond with probability exp(-LIKELY).
LIKELY = 25.0
#: Rows that a document's repetitions are returned in at a time.
REPEATS = 4096
# Fixed value: what words are trimmed of.
TRIMMED = " \t\n\x0b\x0c\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _hashed_words(text: Column, version: int) -> Column:
    """The hash of each word, its lowest bit the number of the version."""
    trimmed = F.btrim(text, F.lit(TRIMMED))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(version)))


def _runs(hashes: Column) -> Column:
    """Of sorted hashes: (hash, number) of each, in order."""

    def counted(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        ends = F.filter(places, lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i + 1)))
        return _let(
            ends,
            lambda e: F.transform(
                e,
                lambda end, k: F.struct(
                    F.get(s, end).alias("hash"), (end - F.coalesce(F.get(e, k - 1), F.lit(-1))).alias("n")
                ),
            ),
        )

    return _let(F.sort_array(hashes), counted)


def weighted_terms(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """A row per document and distinct word of its texts: keys, words_0 and words_1 (of the whole texts), term, and the
    word's number in each text (n_0, n_1; null where it is not). A document without words has one row without term. One row
    of each document is marked as first."""
    versions = range(len(texts))
    counted = rows.select(*keys, *(_hashed_words(F.col(text), v).alias(f"hashes_{v}") for v, text in enumerate(texts)))
    sizes = [F.size(f"hashes_{v}").alias(f"words_{v}") for v in versions]
    runs = counted.select(*keys, *sizes, _runs(F.concat(*(f"hashes_{v}" for v in versions))).alias("runs"))
    # A word's numbers in both versions lie next to each other.
    placed = runs.select("*", F.posexplode_outer("runs").alias("place", "run"))
    term, n = F.col("run.hash"), F.col("run.n")
    before, after = F.get("runs", F.col("place") - 1), F.get("runs", F.col("place") + 1)
    is_second = term.bitwiseAND(F.lit(1)) == 1
    first = F.when(~is_second, n).when(before["hash"] == term - 1, before["n"])
    numbers = [first.alias("n_0"), F.when(is_second, n).alias("n_1")]
    # The second run takes the place of the first one if both are of one word.
    follows = (F.col("place") == 1) & is_second & before["hash"].eqNullSafe(term - 1)
    is_first = F.col("place").isNull() | (F.col("place") == 0) | follows
    return placed.where(term.isNull() | is_second | ~after["hash"].eqNullSafe(term + 1)).select(
        *keys, *(f"words_{v}" for v in versions), F.shiftright(term, 1).alias("term"), *(numbers[v] for v in versions),
        is_first.alias("first"),
    )


def _product(h: Column) -> Column:
    """The product of two uniform numbers in (0, 1), the halves of a hash: exp(-x) of a Gamma(2, 1) variate x."""
    one = F.shiftrightunsigned(h, 32).cast("double") + 0.5
    two = h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + 0.5
    return one * two * F.lit(2.0**-64)


def _minima(
    rows: DataFrame, keys: list[str], texts: list[str], likely: float | None, carried: Sequence[str] = ()
) -> DataFrame:
    """keys, and for each text the array of SAMPLES least values (logarithms of a, a0 and a1) and its number of
    words. With ``likely`` those above ln(likely / words) may not be the least; without it all terms are looked at."""
    versions, samples = range(len(texts)), range(LANE)
    terms = weighted_terms(rows, [*keys, *carried], texts)
    limit = F.lit(float("inf"))
    if likely is not None:
        limit = F.greatest(
            F.lit(0.0), *(F.coalesce(F.col(f"n_{v}") * F.lit(likely) / F.col(f"words_{v}"), F.lit(0.0)) for v in versions)
        )
    sizes = [f"words_{v}" for v in versions]
    lanes = F.array(*(F.lit(lane).cast("long") for lane in range(SAMPLES // LANE)))
    lined = terms.select(
        *keys, *carried, *sizes, "term", "first", limit.alias("limit"), *(F.ln(f"n_{v}").alias(f"ln_{v}") for v in versions),
        F.explode(lanes).alias("lane"),
    )
    passed = [*keys, *carried, *sizes, "lane", *(f"ln_{v}" for v in versions)]

    def hashed(sample: int, which: int) -> Column:
        return F.xxhash64(F.col("term").bitwiseXOR((F.col("lane") * LANE + sample) * 3 + which))

    products = lined.select(
        *passed, "term", "first", "limit", *(_product(hashed(j, w)).alias(f"{name}{j}") for j in samples for w, name in enumerate("pq"))
    )

    def is_small(j: int) -> Column:
        p, q = F.col(f"p{j}"), F.col(f"q{j}")
        return p * (1.0 - q) * 2.0 < F.col("limit") * (1.0 + q)

    def if_small(j: int, value: Column) -> Column:
        return F.when(is_small(j), value)

    # Rows without a small sample are not aggregated, but a row for each document and lane is. Exploded and not
    # filtered: a filter would be moved below the products, which would then be computed twice.
    wanted = reduce(lambda a, b: a | b, (is_small(j) for j in samples), F.col("first"))
    drawn = products.select("*", F.explode(F.when(wanted, F.array(F.lit(True)))).alias("wanted")).select(
        *passed,
        *(if_small(j, -F.ln(f"p{j}")).alias(f"r{j}") for j in samples),
        *(if_small(j, F.ln(-F.ln(f"q{j}"))).alias(f"c{j}") for j in samples),
        *(
            if_small(j, F.shiftrightunsigned(hashed(j, 2), 11).cast("double") * F.lit(2.0**-53)).alias(f"b{j}")
            for j in samples
        ),
    )

    def least(j: int, version: int) -> Column:
        r, b = F.col(f"r{j}"), F.col(f"b{j}")
        t = F.floor(F.col(f"ln_{version}") / r + b).cast("double")
        return F.min(F.col(f"c{j}") - r * (t - b + 1.0)).alias(f"a{version}_{j}")

    # What else is known of a document is carried as numbers beside the minima: every row looks up its key.
    beside = [F.max(c).alias(c) for c in (*carried, *sizes)]
    found = drawn.groupBy(*keys, "lane").agg(*beside, *(least(j, v) for v in versions for j in samples))
    parts = [F.array(*(F.col(f"a{v}_{j}") for j in samples)).alias(f"part_{v}") for v in versions]
    in_lanes = found.select(*keys, *carried, *sizes, F.struct("lane", *parts).alias("samples"))
    gathered = in_lanes.groupBy(*keys).agg(*beside, F.array_sort(F.collect_list("samples")).alias("samples"))
    return gathered.select(*keys, *carried, *sizes, *(F.flatten(F.col(f"samples.part_{v}")).alias(f"a{v}") for v in versions))


def signatures(
    rows: DataFrame, keys: list[str], texts: list[str], likely: float = LIKELY, carried: Sequence[str] = ()
) -> DataFrame:
    """keys (which tell documents apart) and an array of SAMPLES numbers for each of one or two text columns (sig_0, sig_1).

    Rows that are partitioned by some of the keys are not shuffled. ``carried`` are columns of numbers that the keys determine.
    """
    versions = range(len(texts))

    def sure(v: int) -> Column:
        most = F.ln(F.lit(likely) / F.col(f"words_{v}"))
        return (F.col(f"words_{v}") == 0) | F.forall(f"a{v}", lambda a: F.coalesce(a <= most, F.lit(False)))

    quick = _minima(rows, keys, texts, likely, carried).withColumn("sure", reduce(lambda a, b: a & b, (sure(v) for v in versions)))
    quick = stored(quick, "weighted-minima")
    minima, doubtful = quick.where("sure").drop("sure"), quick.where("not sure").select(*keys)
    if not doubtful.isEmpty():
        again = _minima(rows.join(doubtful, keys, "left_semi"), keys, texts, None, carried)
        minima = minima.unionByName(stored(again, "weighted-minima"))

    def sample(value: Column) -> Column:
        return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit(65535)) + 1).cast("int")

    return minima.select(*keys, *carried, *(F.transform(f"a{v}", sample).alias(f"sig_{v}") for v in versions))


def likeness(one: Column, two: Column) -> Column:
    """The share of equal samples, from 0 to 1."""
    return F.size(F.filter(F.zip_with(one, two, lambda x, y: x == y), lambda same: same)) / F.lit(float(SAMPLES))


def as_text(signature: Column) -> Column:
    """Four hexadecimal digits for each sample."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, n (code points), and the key of the document: kid and hash, neither null."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text")).select(
        "id",
        "text",
        F.length("text").alias("n"),
        F.coalesce("id", F.lit(0)).alias("kid"),
        F.xxhash64(F.col("id").isNull(), "text").alias("hash"),
    )


def _in_order(documents: DataFrame) -> DataFrame:
    """The distinct documents without their texts, numbered by id: rank (from 0, without gaps), n_repeats."""
    distinct = documents.groupBy("id", "kid", "hash", "n").agg(F.count("*").alias("n_repeats"))
    order = [F.col("id").asc_nulls_last(), F.col("hash")]
    ranged = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of such a number are the range, the lower 33 count its rows.
    placed = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "document-order")
    of_range = F.shiftright("at", 33)
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(of_range.alias("of")).agg(F.count("*").alias("size"))  # a row per range
    begins = sizes.select("of", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begin"))
    return placed.join(F.broadcast(begins), of_range == F.col("of")).select(
        *distinct.columns, (F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")
    )


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each distinct document with an edited version: its last quarter is replaced by as much of the next document's start.

    kid, hash (the key that the rows are partitioned by), id, n, n_repeats, rank, next_rank, text, edited.
    """
    documents = _documents(docs, id_col, text_col)
    ranked = stored(_in_order(documents), "document-ranks")
    n_docs = F.lit(ranked.count())
    # The document before, to which a document's start is sent.
    previous = ranked.select(
        F.pmod(F.col("rank") + 1, n_docs).alias("rank"),
        F.col("kid").alias("to_kid"),
        F.col("hash").alias("to_hash"),
        F.floor(F.col("n") / 4).cast("int").alias("to_n"),
    )
    chain = stored(ranked.join(previous, "rank"), "document-chain")
    once = Window.partitionBy("kid", "hash").orderBy(F.lit(1))
    # Of the documents both sides read the same columns, so that the texts are shuffled once for both.
    whole = documents.select("kid", "hash", "text").join(chain, ["kid", "hash"])
    whole = whole.withColumn("nth", F.row_number().over(once)).where("nth = 1")
    starts = whole.select(
        F.col("to_kid").alias("kid"), F.col("to_hash").alias("hash"), F.expr("substring(text, 1, to_n)").alias("start")
    )
    kept = F.expr("substring(text, 1, n - cast(floor(n / 4) as int))")
    return whole.join(starts, ["kid", "hash"]).select(
        "kid",
        "hash",
        "id",
        "n",
        "n_repeats",
        "rank",
        F.pmod(F.col("rank") + 1, n_docs).alias("next_rank"),
        "text",
        F.concat(kept, "start").alias("edited"),
    )


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, and the likeness of its
    fingerprint to the edited version's (near_edited) and to the next document's (near_next)."""
    rows = edited_versions(docs, id_col, text_col).withColumn("sha", F.sha2("edited", 256))
    # The digest as four signed numbers.
    rows = rows.withColumns({f"sha_{i}": F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)})
    carried = ["id", "n", "n_repeats", "rank", "next_rank", *(f"sha_{i}" for i in range(4))]
    signed = signatures(rows, ["kid", "hash"], ["text", "edited"], carried=carried)
    sha = F.concat(*(F.lower(F.lpad(F.hex(f"sha_{i}"), 16, "0")) for i in range(4)))
    following = signed.select(F.col("rank").alias("next_rank"), F.col("sig_0").alias("sig_next"))
    found = signed.join(following, "next_rank").select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        sha.alias("edited_sha256"),
        as_text(F.col("sig_0")).alias("fingerprint"),
        as_text(F.col("sig_1")).alias("edited_fingerprint"),
        likeness(F.col("sig_0"), F.col("sig_1")).alias("near_edited"),
        likeness(F.col("sig_0"), F.col("sig_next")).alias("near_next"),
        "n_repeats",
    )
    # Repeated rows: a row each, in steps so that no array grows with their number.
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_repeats") - 1) / F.lit(REPEATS)))
    stepped = found.select("*", F.explode(steps).alias("step"))
    left = F.least(F.lit(REPEATS).cast("long"), F.col("n_repeats") - F.col("step") * REPEATS)
    return stepped.select("*", F.explode(F.sequence(F.lit(1).cast("long"), left)).alias("copy")).drop("n_repeats", "step", "copy")
