from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from orderloom.llm import exact_dedup, links, simhash
from tests.llm.helpers import LONG, ODD, docs, nothing


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_copies_against_grouping(spark):
    got = exact_dedup.find_copies(docs(spark)).collect()
    groups = defaultdict(list)
    for i, text, _ in ODD:
        groups[squeezed(text)].append(i)
    assert len(got) == len(ODD)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        rows = [r for r in got if r.text_sha256 == sha]
        smallest = min((i for i in ids if i is not None), default=None)
        assert len(rows) == len(ids) and {r.group_size for r in rows} == {len(ids)}
        assert {r.keep_id for r in rows} == {smallest}
        assert [r.doc_id for r in rows if r.kept] == [smallest]


def test_copies_of_nothing(spark):
    assert exact_dedup.find_copies(nothing(spark)).count() == 0
    assert exact_dedup.drop_copies(nothing(spark)).columns == ["doc_id", "text", "source"]


def test_drop_copies_keeps_whole_rows(spark):
    table = docs(spark)
    kept = exact_dedup.drop_copies(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 7, 8]
    assert kept.where("doc_id = 7").first().text == LONG


def test_a_text_with_most_rows_is_dealt_to_several_ranges(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}", "s") for i in range(3000)]
    table = docs(spark, rows, clashing=False)
    base = table.selectExpr("doc_id as id", "text as body")
    assert exact_dedup._pieces(base).where("split").select("first").distinct().count() > 1
    got = {r.doc_id: r for r in exact_dedup.find_copies(table).collect()}
    assert sum(r.kept for r in got.values()) == 1001
    assert {(got[i].keep_id, got[i].group_size) for i in range(3000) if i % 3} == {(1, 2000)}
    assert exact_dedup.drop_copies(table).count() == 1001


def test_content_sort_has_one_shuffle_of_the_texts_and_no_python(spark):
    table = docs(spark, clashing=False)
    plan = exact_dedup._pieces(table.selectExpr("doc_id as id", "text as body"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("rangepartitioning") == 1 and "Python" not in physical and "InArrow" not in physical
    assert "hashpartitioning(lead" not in physical


# SimHash ------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=2):
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(prints, 2):
        if (x ^ y).bit_count() <= most and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i, _ in prints}


def test_classes_against_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 40, 400]))), "s") for i in range(150)]
    for i in range(150, 300):
        near = rows[rng.randrange(150)][1].split()
        near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((i, " ".join(near), "s"))
    rows += [(300, None, "s"), (301, "", "s"), (302, "ALPHA", "s"), (303, "alpha", "s"), (304, LONG, "s")]
    got = {r.doc_id: r for r in simhash.classes(docs(spark, rows)).collect()}
    prints = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    assert {i: r.fp % 2**64 for i, r in got.items()} == dict(prints)
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)


def prints_table(spark, prints):
    return spark.createDataFrame([(i, p - 2**64 if p >> 63 else p) for i, p in prints], "id long, fp long")


def test_hot_segments_lose_no_link(spark):
    """Many fingerprints with one half in common, some of them linked: more than are joined pair by pair."""
    rng = np.random.default_rng(5)
    half = int(rng.integers(1 << 32))
    low = rng.choice(1 << 12, 300, replace=False).tolist()
    prints = [(i, half << 32 | x) for i, x in enumerate(low)]
    prints += [(300 + i, int(rng.integers(1 << 32)) << 32 | half) for i in range(200)]
    prints += [(500 + i, p ^ 1 << int(rng.integers(64)) ^ 1 << int(rng.integers(64))) for i, (_, p) in enumerate(prints[:250])]
    scheme = simhash.Scheme(most_in_bucket=16)
    got = {r.id: r.component_id for r in simhash._classes(prints_table(spark, prints), scheme).collect()}
    want = brute_components(prints)
    by_print = defaultdict(list)
    for i, p in prints:
        by_print[p].append(i)
    assert got == want


def test_odd_documents_have_classes(spark):
    got = simhash.classes(docs(spark)).collect()
    assert len(got) == len(ODD)
    empty = {r.doc_id: r.component_id for r in got if r.fp == 0}
    assert empty == {5: 3, 6: 3, 3: 3}
    assert {r.component_id for r in got if r.doc_id in (8, 9, None)} == {8}
    assert simhash.classes(nothing(spark)).count() == 0


def test_near_copies_go_with_whole_rows(spark):
    """Of each class by brute force the smallest id stays, with all columns; rows of one id go together."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    texts = [rng.choices(words, k=600) for _ in range(30)]
    rows = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:20]):
        changed = list(t)
        changed[rng.randrange(600)] = "other"
        rows.append((100 + i, " ".join(changed), "s"))
    table = docs(spark, rows)
    kept = simhash.drop_near_copies(table)
    assert kept.columns == table.columns
    classes = brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows])
    want = sorted(set(classes.values()))
    assert len(want) < len(rows) - 5
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert simhash.drop_near_copies(nothing(spark)).count() == 0


def test_a_search_that_would_miss_links_is_refused():
    for radii, most in (((1, 0), 3), ((0, 0), 2), ((1, 1), 3)):
        with pytest.raises(ValueError):
            simhash.Scheme(radii=radii, max_distance=most)


@pytest.mark.parametrize(
    "edges", [[], [(1, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)] + [(400, 401), (401, 399)]]
)
def test_components_of_chains_and_stars(spark, edges):
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in links.components(table).collect()}
    nodes = sorted({x for e in edges for x in e})
    parent = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
