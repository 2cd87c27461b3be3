from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from orderloom.llm import prefix_trie, vector_codes, weighted_sampling
from orderloom.llm.queries import LLM_QUERIES
from tests.llm.helpers import LONG, docs, nothing, sample

SF = "/root/testdata/sf0.001"

# Vector codes -------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, part string, row string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], VECTORS)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Plain loops over whole vectors, without blocks or boxes."""
    good = [
        (i, [math.floor(4096 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) // parts
    cut = [[v[p * width : p * width + width] for p in range(parts)] for _, v, _ in good]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[nearest(c[p], books[p])[1]].append(c[p])
            for e, own in members.items():
                books[p][e] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    out = []
    for (i, _, label), c in zip(good, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    by_label = Counter()
    for _, _, error, label in out:
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted([(i, code, error, by_label[label], digest) for i, code, error, label in out], key=repr)


def got_codes(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clustered(n, seed, length=16):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, length))
    found = middles[rng.integers(6, size=n)] + rng.normal(scale=0.1, size=(n, length))
    return [(int(i), [float(x) for x in v], int(i) % 3 if i % 5 else None) for i, v in enumerate(found)]


@pytest.mark.parametrize("length", [8, 16, 40])
def test_codes_against_plain_loops(spark, length):
    rows = clustered(700, length, length)
    assert got_codes(vector_codes.compress(vectors(spark, rows))) == brute_codes(rows)


def test_codes_with_ties_and_one_vector_in_most_rows(spark):
    rng = random.Random(3)
    hot = [0.5, -0.25] * 4
    rows = [(i, hot if i % 3 else [rng.choice([-1.0, 0.0, 1.0]) for _ in range(8)], i % 2) for i in range(1500)]
    table = vectors(spark, rows)
    assert got_codes(vector_codes.compress(table)) == brute_codes(rows)
    kept = vector_codes._kept(table, "vec_id", "embedding", "label")
    layout = vector_codes._layout(kept, 8, 8)
    curve = vector_codes._on_curve(kept, layout).repartitionByRange(8, "place", "row")
    sizes = [r["count"] for r in curve.groupBy(vector_codes.F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 8


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(40, 9)
    length = len(rows[0][1])
    rows += [
        (100, None, 1), (101, [None] * length, 1), (102, [nan] + [0.0] * (length - 1), 1), (103, [inf] * length, None),
        (None, [0.25] * length, None), (5, rows[5][1], 7), (5, rows[6][1], 7),
    ]
    assert got_codes(vector_codes.compress(vectors(spark, rows))) == brute_codes(rows)
    shorter = rows + [(200, [1.0] * 8, 1), (201, [], 1)]
    assert got_codes(vector_codes.compress(vectors(spark, shorter))) == brute_codes(rows)
    few = rows[:3]
    assert got_codes(vector_codes.compress(vectors(spark, few))) == brute_codes(few)
    assert got_codes(vector_codes.compress(vectors(spark, [(1, [], None)]))) == brute_codes([(1, [], None)])


def test_codes_of_nothing(spark):
    found = vector_codes.compress(vectors(spark, []))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert found.count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 2)])).count() == 0


def test_lengths_and_sizes_that_cannot_be_coded(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, [(1, [1.0] * 9, 2)]))
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(vectors(spark, [(1, [1.0] * 8, 2), (2, [1e9] * 8, 2)])).collect()


def test_the_curve_visits_every_cell_in_neighbouring_steps():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
        order = vector_codes.hilbert_places(cells, bits)
        assert sorted(order.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(order)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_short_lists_hold_every_nearest_entry():
    rng = np.random.default_rng(1)
    lengths = []
    for _ in range(200):
        entries = rng.integers(-50, 50, (16, 3))
        parts = rng.integers(-50, 50, 3) + rng.integers(-4, 5, (30, 3))
        listed = vector_codes.short_list(parts.min(axis=0), parts.max(axis=0), entries)
        found, error = vector_codes.nearest(parts, entries)
        assert set(found) <= set(listed)
        again, same = vector_codes.nearest(parts, entries[listed])
        assert (listed[again] == found).all() and (same == error).all()
        lengths.append(len(listed))
    assert np.mean(lengths) < 5


# Weighted sampling --------------------------------------------------------------------------------

MASK = (1 << 64) - 1


def brute_samples(text):
    """(term, t) of each sample, straight from the definition."""
    counts = Counter(xxhash.xxh64_intdigest(w.encode(), 42) >> 1 << 1 for w in brute_words(text))
    found = []
    for number in range(weighted_sampling.SAMPLES):
        best = None
        for term, n in counts.items():
            term = (term - (1 << 64) if term >> 63 else term) >> 1
            lane, j = divmod(number, weighted_sampling.LANE)
            draws = [
                xxhash.xxh64_intdigest(((term ^ (lane * weighted_sampling.LANE + j) * 3 + w) & MASK).to_bytes(8, "little"), 42)
                for w in range(3)
            ]
            r, c = (-math.log(((h >> 32) + 0.5) * ((h & 0xFFFFFFFF) + 0.5) * 2.0**-64) for h in draws[:2])
            b = (draws[2] >> 11) * 2.0**-53
            t = math.floor(math.log(n) / r + b)
            a = math.log(c) - r * (t - b) - r
            if best is None or a < best[0]:
                best = (a, term, t)
        found.append(best and best[1:])
    return found


def brute_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute_likeness(one, two):
    return sum(x == y for x, y in zip(one, two, strict=True)) / len(one)


def brute_fingerprints(rows):
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    out = {}
    for at, (i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        m = len(text) // 4
        edited = text[: len(text) - m] + following[:m]
        own = brute_samples(text)
        out[i, text] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(),
            brute_likeness(own, brute_samples(edited)), brute_likeness(own, brute_samples(following)),
        )
    return out


def prose(rng, n):
    return " ".join(rng.choices(["a", "be", "see", "dé", "eff", "gé", "aitch", "I"], k=n))


def test_fingerprints_against_the_definition(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([1, 2, 7, 30, 120]))) for i in range(60)]
    rows += [(60, rows[59][1]), (61, ""), (62, None), (63, " \n\t "), (64, rows[59][1] + " x"), (-7, "🙂 🙂🙂 x y z"), (None, "last one of all")]
    table = docs(spark, [(i, t, "s") for i, t in rows])
    got = weighted_sampling.fingerprints_of_edits(table).collect()
    want = brute_fingerprints(rows)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == want[r.doc_id, texts[r.doc_id] or ""]
    prints = defaultdict(set)
    for r in got:
        prints[tuple(brute_words(texts[r.doc_id]))].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    empty = {r.fingerprint for r in got if r.doc_id in (61, 62, 63)}
    assert empty == {"0" * 4 * weighted_sampling.SAMPLES}


def test_repeated_rows_and_long_texts_have_fingerprints(spark):
    rows = [(1, "one two three four", "s")] * 3 + [(2, LONG, "s"), (2, "another text of two", "s"), (None, None, "s"), (None, "x", "s")]
    got = weighted_sampling.fingerprints_of_edits(docs(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert len({tuple(r) for r in got if r.doc_id == 1}) == 1
    assert {r.n_chars for r in got if r.doc_id == 2} == {len(LONG), len("another text of two")}
    assert weighted_sampling.fingerprints_of_edits(nothing(spark)).count() == 0
    alone = weighted_sampling.fingerprints_of_edits(docs(spark, [(4, "abcd efgh", "s")], clashing=False)).first()
    assert alone.near_next == 1.0
    assert alone.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()


def test_collisions_estimate_the_generalised_jaccard_similarity(spark):
    rng = random.Random(8)
    rows, truth = [], []
    for i in range(60):
        one = Counter(rng.choices(range(40), k=150))
        two = Counter(rng.choices(range(40), k=150)) if i % 2 else one + Counter(rng.choices(range(60), k=60))
        rows.append((i, " ".join(f"w{x}" for x in one.elements()), " ".join(f"w{x}" for x in two.elements())))
        truth.append(sum((one & two).values()) / sum((one | two).values()))
    table = spark.createDataFrame(rows, "id long, x string, y string")
    signed = weighted_sampling.signatures(table, ["id"], ["x", "y"])
    got = {r.id: r.near for r in signed.select("id", weighted_sampling.likeness(signed.sig_0, signed.sig_1).alias("near")).collect()}
    errors = np.array([got[i] - truth[i] for i in range(60)])
    assert abs(errors.mean()) < 4 * 0.5 / (64 * 60) ** 0.5
    assert np.abs(errors).max() < 4.5 * 0.5 / 64**0.5


@pytest.mark.parametrize("likely", [0.0, 0.3, 3.0])
def test_skipping_terms_changes_nothing(spark, likely):
    """However low the limit below which least values are looked for, and with it the share of documents done again."""
    rng = random.Random(9)
    texts = [prose(rng, rng.choice([0, 1, 5, 60])) + " " + " ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in range(0, 200, 4)]
    table = spark.createDataFrame([(i, x, x[len(x) // 3 :]) for i, x in enumerate(texts)], "id long, x string, y string")
    got = {r.id: (r.sig_0, r.sig_1) for r in weighted_sampling.signatures(table, ["id"], ["x", "y"], likely).collect()}
    assert got == {r.id: (r.sig_0, r.sig_1) for r in weighted_sampling.signatures(table, ["id"], ["x", "y"], 1e9).collect()}
    assert len(got) == len(texts)


def test_fingerprints_run_without_python(spark):
    plan = LLM_QUERIES["op12_document_fingerprint"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
    texts = weighted_sampling.edited_versions(sample(spark, "documents"))
    signed = weighted_sampling._minima(texts, ["kid", "hash"], ["text", "edited"], weighted_sampling.LIKELY)
    physical = signed._jdf.queryExecution().executedPlan().toString()
    before = texts._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == before.count("Exchange")  # words and samples are not shuffled


def test_terms_without_small_samples_are_not_aggregated(spark):
    rows = [(1, "a b a c", "c b a c"), (2, "", "b"), (3, "", ""), (4, " ".join(f"w{i}" for i in range(5000)), "w1 x")]
    table = spark.createDataFrame(rows, "id long, x string, y string")
    # With a limit that no sample is below, only one row a document and lane is left, and no document is lost.
    found = weighted_sampling._minima(table, ["id"], ["x", "y"], 1e-12)
    got = {r.id: (r.words_0, r.words_1, set(r.a0), len(r.a0), set(r.a1), len(r.a1)) for r in found.collect()}
    n, nothing_found = weighted_sampling.SAMPLES, {None}
    assert got == {i: (len(x.split()), len(y.split()), nothing_found, n, nothing_found, n) for i, x, y in rows}
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[.*lane(.|\n)*Generate explode\(CASE WHEN", optimized)


def test_the_query_of_fingerprints_covers_the_table(spark):
    rows = [(r.doc_id, r.text) for r in sample(spark, "documents").collect()]
    rows = [(i, t) for i, t in rows if len(t or "") < 3000]
    table = docs(spark, [(i, t, "s") for i, t in rows], clashing=False)
    got = {r.doc_id: tuple(r)[1:3] + tuple(r)[5:] for r in weighted_sampling.fingerprints_of_edits(table).collect()}
    assert got == {i: v for (i, _), v in brute_fingerprints(rows).items()}
    assert LLM_QUERIES["op12_document_fingerprint"](spark, SF).count() == sample(spark, "documents").count()


# Prefix trie --------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, conv string, pos int, a int, block int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TURNS)


def in_order(rows):
    own = defaultdict(list)
    for conv, turn, role, text in sorted(
        ((c, t, r or "", x or "") for c, t, r, x in rows if c is not None),
        key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()),
    ):
        own[conv].append((role, text))
    return own


def brute_trie(sequences):
    members = defaultdict(list)
    for conv in sorted(sequences):
        seq = sequences[conv]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(conv)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, own in members.items():
        words = len(brute_words(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(own) - 1) * words
    out = []
    for path, own in members.items():
        ends = ",".join(str(c) for c in own if len(sequences[c]) == len(path))
        out.append((
            own[0], len(path), members[path[:-1]][0] if path else None, len(own), children[path], leaves[path], saved[path],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got_trie(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_trie_against_plain_prefixes(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        for turn in range(rng.choice([1, 2, 5, 8, 9, 16, 17])):
            rows.append((conv, turn, rng.choice(["user", "assistant"]) if turn > 6 else "user", f"turn {turn % 3} of {rng.choice('ab') if turn % 4 == 3 else 'all'}"))
    rows += [(500, t, "user", f"long {t}") for t in range(70)] + [(501, t, "user", f"long {t}") for t in range(70)]
    rows += [(502, t, "user", f"long {t if t != 40 else 'other'}") for t in range(45)]
    rng.shuffle(rows)
    got = got_trie(prefix_trie.build(prefix_trie.numbered(turns(spark, rows))))
    assert got == brute_trie(in_order(rows))


def test_odd_turns(spark):
    rows = [
        (1, None, "user", "first"), (1, 3, None, None), (1, 3, "", ""), (2, 0, "user", "first"), (2, 1, "", None),
        (None, 1, "user", "nobody's"), (3, 5, "user", LONG), (4, 5, "user", LONG), (4, 5, "user", LONG), (-5, 1, "user", "first"),
    ]
    assert got_trie(prefix_trie.build(prefix_trie.numbered(turns(spark, rows)))) == brute_trie(in_order(rows))
    nothing_left = prefix_trie.build(prefix_trie.numbered(turns(spark, [])))
    assert nothing_left.count() == 0


def test_one_conversation_in_most_rows_and_many_equal_ones(spark, monkeypatch):
    """A long conversation over several ranges, and one that two thousand others repeat, in small pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 16)
    rows = [(7, t, "user", f"t{t % 50}") for t in range(1500)]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(700) for t in range(2)]
    table = turns(spark, rows).repartition(8)
    numbered = prefix_trie.numbered(table)
    assert sorted(r.pos for r in numbered.where("conv = 7").collect()) == list(range(1, 1501))
    assert got_trie(prefix_trie.build(numbered)) == brute_trie(in_order(rows))


def test_query_of_the_trie_against_plain_prefixes(spark):
    rows = [tuple(r) for r in sample(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    own = in_order(rows)
    rebuilt = {}
    for conv, seq in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rebuilt[conv] = own.get(conv - conv % 20, [])[:h] + seq[h:]
    assert got_trie(LLM_QUERIES["op13_prefix_trie"](spark, SF)) == brute_trie(rebuilt)
