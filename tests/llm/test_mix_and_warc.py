from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orderloom.llm import source_mix, warc
from tests.llm.helpers import ODD, docs, nothing


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    """Shares the words again and again until no target is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        share = rest / sum(weight[s] for s in free) if free else 0
        target = {s: most * sizes[s] if s in full else weight[s] * share for s in order}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100},
        {"a": 1, "b": 1000, "c": 50},
        {"a": 10, "b": 10, "c": 10, None: 500},
        {"Z": 3, "a": 700, "é": 20, "b": 0, "c": 9, "d": 10_000},
        {f"s{i:03}": (i * 7919) % 400 for i in range(60)},
    ],
)
def test_targets_against_resharing(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_mix.source_targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_plan_of_odd_documents(spark):
    got = source_mix.mix_plan(docs(spark)).collect()
    assert len(got) == len(ODD)
    sizes = Counter()
    for _, text, source in ODD:
        sizes[source] += len((text or "").split())
    targets = brute_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(targets[next(s for s in sizes if sizes[s] == r.source_size)])
        assert r.taken == r.copies * r.size and r.copies <= 3
    assert source_mix.mix_plan(nothing(spark)).count() == 0
    assert source_mix.mix(nothing(spark)).count() == 0


def test_mix_emits_whole_rows_as_planned(spark):
    rows = [(i, "some words of a text " * (i % 5 + 1), f"s{i % 7}") for i in range(700)]
    table = docs(spark, rows)
    plan = {r.doc_id: r for r in source_mix.mix_plan(table).collect()}
    out = source_mix.mix(table)
    assert out.columns == table.columns
    counts = Counter(r.doc_id for r in out.collect())
    assert {i: counts.get(i, 0) for i in plan} == {i: r.copies for i, r in plan.items()}
    taken, target = Counter(), {}
    for i, r in plan.items():
        taken[i % 7] += r.taken
        target[i % 7] = r.target
    assert all(abs(taken[s] - t) < 0.25 * t for s, t in target.items())
    again = Counter(r.doc_id for r in source_mix.mix(table.repartition(5)).collect())
    assert again == counts


# WARC ---------------------------------------------------------------------------------------------

DAY = datetime(2024, 1, 1)
SCHEMA = (
    "record_id long, warc_type string, target_uri string, warc_date timestamp, status int, "
    "headers array<struct<name:string,value:string>>, payload string"
)


def response(i, url, hours, etag="a", status=200, **more):
    headers = [("ETag", f'"{etag}"'), ("Content-Type", "text/html"), ("Vary", "x"), *more.items()]
    at = None if hours is None else DAY + timedelta(hours=hours)
    return (i, "response", url, at, status, headers, f"body {i}")


def revisit(i, url, hours, headers):
    return (i, "revisit", url, DAY + timedelta(hours=hours), 304, headers, None)


def resolved(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as url")
    return {r.record_id: r for r in warc.resolve(table).collect()}


def test_revisits_take_the_latest_earlier_full_response(spark):
    tag = [("etag", 'W/"a"'), ("Content-Length", "0"), ("Vary", "y"), ("vary", "z"), (None, "q")]
    got = resolved(
        spark,
        [
            response(1, "http://www.H.example:80/p/?b=2&a=1&utm_source=x#f", 1),
            response(2, "https://h.example/p?a=1&b=2", 2),
            response(3, "https://h.example/p?a=1&b=2", 3, status=206),
            response(4, "https://h.example/p?a=1&b=2", 9, etag="c"),
            response(4, "https://h.example/p?a=1&b=2", 9, etag="c"),
            response(5, None, 1),
            response(6, "https://h.example/p?a=1&b=2", None),
            revisit(10, "h.example/p?a=1&b=2", 4, tag),
            revisit(11, "http://h.example/p?b=2&a=1", 2, tag),
            revisit(12, "http://h.example/p?b=2&a=1", 10, tag),
            revisit(13, "http://h.example/p?b=2&a=1", 1, tag),
            revisit(14, "http://h.example/other", 5, tag),
            revisit(15, "http://h.example/p?b=2&a=1", 5, None),
            revisit(15, "http://h.example/p?b=2&a=1", 5, None),
            revisit(16, None, 5, tag),
            (17, "request", "http://h.example/p?b=2&a=1", DAY, None, None, None),
            (None, "revisit", "http://h.example/p?b=2&a=1", DAY, None, None, None),
        ],
    )
    assert {i: (r.response_id, r.outcome) for i, r in got.items()} == {
        10: (2, "validated"),
        11: (1, "validated"),
        12: (4, "mismatch"),
        13: (None, "unmatched"),
        14: (None, "unmatched"),
        15: (2, "unchecked"),
        16: (None, "unmatched"),
    }
    assert got[10].payload == "body 2"
    assert got[10].headers == {"etag": 'W/"a"', "content-type": "text/html", "vary": "z"}
    assert got[12].payload is None and got[12].headers is None
    assert got[15].headers == {"etag": '"a"', "content-type": "text/html", "vary": "x"}


def test_last_modified_is_compared_where_there_is_no_tag(spark):
    rows = [
        response(1, "http://h/", 1, **{"Last-Modified": "then"}),
        revisit(2, "http://h/", 2, [("last-modified", "then")]),
        revisit(3, "http://h/", 2, [("last-modified", "now")]),
    ]
    assert {i: r.outcome for i, r in resolved(spark, rows).items()} == {2: "validated", 3: "mismatch"}


def test_a_url_with_most_records_lies_across_partitions(spark):
    """Against carrying the last response forward in one list; more ranges than one for the hot URL."""
    rows = []
    for i in range(1500):
        url = "http://hot/" if i % 3 else f"http://h{i % 40}/"
        if i % 50 == 0 or i == 1:
            rows.append(response(i, url, i))
        else:
            rows.append(revisit(i, url, i, [("etag", '"a"')]))
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r.record_id: r.response_id for r in warc.resolve(table).collect()}
    last, want = {}, {}
    for i, kind, url, *_ in rows:
        if kind == "response":
            last[url] = i
        else:
            want[i] = last.get(url)
    assert got == want


def test_revisits_without_response_are_spread(spark):
    """Two thousand revisits that match nothing, by date or by a missing URL: no task of the join has most of them."""
    rows = [(i, "revisit", f"http://h{i}/" if i % 2 else None, None if i % 3 == 0 else i) for i in range(2000)]
    table = spark.createDataFrame(rows, "record_id long, warc_type string, target_uri string, at long").selectExpr(
        "*", "timestamp_seconds(at) as warc_date", "304 as status", "'x' as payload",
        "array(named_struct('name', 'etag', 'value', 'x')) as headers",
    )
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for key, value in zip(old, ("false", "-1"), strict=True):
        spark.conf.set(key, value)
    try:
        found = warc.resolve(table)
        assert found.count() == 2000 and {r.outcome for r in found.select("outcome").distinct().collect()} == {"unmatched"}
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert len(sizes) > 4 and max(sizes) < 2000 / 3


def test_no_records(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
