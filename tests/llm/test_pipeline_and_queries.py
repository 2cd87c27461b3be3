from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import corpus_pipeline  # noqa: E402
from compare import duck, expected, rows_of  # noqa: E402
from orderloom.llm import source_mix, toxicity  # noqa: E402
from orderloom.llm.queries import LLM_ORACLE, LLM_QUERIES  # noqa: E402
from tests.llm.test_dedup import brute_components, brute_fingerprint, squeezed  # noqa: E402
from tests.llm.test_text_scans import brute_distance  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_matches_sql(spark, name):
    df = LLM_QUERIES[name](spark, SF)
    assert rows_of(df.columns, df.collect()) == expected(duck(SF), LLM_ORACLE[name])


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in LLM_QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_license_scan", "op10_html_text"])
def test_query_runs_over_the_table(spark, name):
    assert LLM_QUERIES[name](spark, SF).count() > 0


def test_stages_against_brute_force(spark):
    """Every stage on what its predecessor kept, in plain Python over the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    kept = docs
    done = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == columns
        done[name] = {r.doc_id: r for r in kept.collect()}
        kept = spark.createDataFrame(list(done[name].values()), docs.schema)
        assert all(rows[i] == r for i, r in done[name].items())

    weights = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    assert set(done["toxicity"]) == {i for i, s in scores.items() if s < 0.5}

    first = {}
    for i in sorted(done["toxicity"]):
        first.setdefault(squeezed(rows[i].text), i)
    assert set(done["exact_dedup"]) == set(first.values())

    classes = brute_components([(i, brute_fingerprint(rows[i].text)) for i in sorted(done["exact_dedup"])])
    assert set(done["simhash"]) == set(classes.values())

    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {
        i
        for i in done["simhash"]
        if all(brute_distance(item, words(rows[i].text)) > int(0.2 * len(item)) for item in likely(items, rows[i].text))
    }
    assert set(done["decontaminate"]) == clean

    plan = {r.doc_id: r.copies for r in source_mix.mix_plan(kept).collect()}
    mixed = Counter(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect())
    assert {i: mixed.get(i, 0) for i in plan} == plan
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == mixed


def words(text):
    from orderloom.llm.decontaminate import _bare

    return [_bare(w) for w in text.encode().split()]


def likely(items, text):
    """Items that share enough words with a text to be within the distance at all."""
    known = set(words(text))
    return [item for item in items if sum(w in known for w in item) >= 0.8 * len(item) - 1e-9]
