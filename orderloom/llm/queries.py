"""The operators over the driver's whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    license_scan,
    prefix_trie,
    quality,
    secret_scan,
    simhash,
    source_mix,
    toxicity,
    vector_codes,
    warc,
    weighted_sampling,
)

Query = Callable[[SparkSession, str], DataFrame]

LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLE: dict[str, str] = {}


def _query(function: Query) -> Query:
    LLM_QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs))


@_query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = source_mix.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


# The limits bind in the order of limit / weight, so the number of full sources is the first k for which
# the rest, shared by weight, stays below the next limit.
LLM_ORACLE["op2_source_mix"] = """
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
    FROM documents
), totals AS (
    SELECT source, sum(size) AS source_size,
           CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
    FROM sized GROUP BY source
), ordered AS (
    SELECT *, source_size * 3.0::DOUBLE AS most,
           coalesce(sum(source_size * 3.0::DOUBLE) OVER before, 0) AS full_words,
           sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left,
           sum(source_size) OVER () AS total
    FROM totals
    WINDOW before AS (ORDER BY source_size * 3.0 / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shared AS (
    SELECT arg_min((total - full_words) / weight_left, most / weight) AS share FROM ordered
    WHERE (total - full_words) / weight_left < most / weight
), targets AS (
    SELECT source, source_size, least(most, weight * share) AS target,
           CASE WHEN source_size > 0 THEN least(most, weight * share) / source_size ELSE 0 END AS rate
    FROM totals JOIN ordered USING (source, source_size, weight), shared
), drawn AS (
    SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
           CAST(floor(rate) AS BIGINT) + CASE WHEN
               CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE
               < rate - floor(rate) THEN 1 ELSE 0 END AS copies
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM drawn
"""


@_query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

    def joined(findings):
        spans = F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"]))
        return F.array_join(spans, ",")

    def number(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")

    kinds = [rule.kind for rule in secret_scan.BASE_RULES]
    base = F.filter("findings", lambda f: f["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in kinds),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def _captures(pages: DataFrame) -> DataFrame:
    """Archive records made of the pages: each is captured, for every third once more in a new version, and
    visited again; every fourth was also visited before. Some visits lack validators or have strange ones."""
    page, k = F.col("page_id"), F.col("k")
    tag = F.concat(F.md5("html"), F.when((k == 1) | ((k == 2) & (page % 3 == 0)), "-2").otherwise(""))
    weak = F.when(page % 5 == 1, '"other"').otherwise(F.concat(F.lit('W/"'), tag, F.lit('"')))
    revisit = k >= 2

    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    unchanged = F.concat(F.lit("day "), page.cast("string"))
    response = F.array(
        header("Content-Type", F.lit("text/html")),
        header("ETag", F.concat(F.lit('"'), tag, F.lit('"'))),
        header("Last-Modified", unchanged),
        header("Date", F.concat(F.lit("at "), k.cast("string"))),
        header("Cache-Control", F.lit("max-age=60")),
    )
    again = F.array(
        F.when(page % 7 != 2, header("ETag", weak)).otherwise(header("last-modified", unchanged)),
        header("Date", F.concat(F.lit("at "), k.cast("string"))),
        header("Content-Length", F.lit("0")),
        header("Cache-Control", F.lit("max-age=3600")),
    )
    seconds = F.element_at(F.array(*map(F.lit, (0, 600, 900, -60))), k + 1)
    return (
        pages.withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
        .where((k == 0) | (k == 2) | ((k == 1) & (page % 3 == 0)) | ((k == 3) & (page % 4 == 0)))
        .select(
            (page * 4 + k).alias("record_id"),
            F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
            F.when(revisit, F.concat("url", F.lit("#again"))).otherwise(F.col("url")).alias("target_uri"),
            F.timestamp_seconds(page * 60 + seconds).alias("warc_date"),
            F.when(revisit, 304).otherwise(200).alias("status"),
            F.when(revisit, again).otherwise(response).alias("headers"),
            F.when(k == 0, F.col("html")).when(k == 1, F.concat("html", F.lit("<!-- 2 -->"))).alias("payload"),
        )
    )


@_query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(_captures(_table(spark, sf_dir, "pages")))
    names = F.array_sort(F.map_keys("headers"))
    lines = F.transform(names, lambda n: F.concat(n, F.lit(": "), F.col("headers")[n]))
    return found.select(
        "record_id",
        "response_id",
        "outcome",
        F.array_join(lines, "\n").alias("headers"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.length("payload").cast("long").alias("n_chars"),
    )


LLM_ORACLE["op4_warc"] = r"""
WITH bare AS (
    SELECT page_id, url, html,
           regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS u
    FROM pages
), parts AS (
    SELECT page_id, html,
           regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '') AS host,
           regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
           list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
               lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS params
    FROM bare
), captured AS (
    SELECT page_id AS p, k, html, p * 4 + k AS id, p * 60 + [0, 600, 900, -60][k + 1] AS ts,
           host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url
    FROM parts, unnest([0, 1, 2, 3]) AS t(k)
    WHERE k IN (0, 2) OR (k = 1 AND page_id % 3 = 0) OR (k = 3 AND page_id % 4 = 0)
), responses AS (
    SELECT url, ts, max(id) AS response_id FROM captured WHERE k < 2 GROUP BY url, ts
), tagged AS (
    SELECT *, CASE WHEN p % 7 = 2 THEN NULL WHEN p % 5 = 1 THEN 'other'
                   ELSE md5(html) || CASE WHEN k = 2 AND p % 3 = 0 THEN '-2' ELSE '' END END AS tag
    FROM captured WHERE k >= 2
), matched AS (
    SELECT v.*, r.response_id FROM tagged v ASOF LEFT JOIN responses r ON v.url = r.url AND v.ts > r.ts
), judged AS (
    SELECT v.*, s.p AS origin, s.html AS body, s.k AS version,
           CASE WHEN s.id IS NULL THEN 'unmatched'
                WHEN coalesce(v.tag, 'day ' || v.p) =
                     CASE WHEN v.tag IS NULL THEN 'day ' || s.p
                          ELSE md5(s.html) || CASE WHEN s.k = 1 THEN '-2' ELSE '' END END THEN 'validated'
                ELSE 'mismatch' END AS outcome
    FROM matched v LEFT JOIN captured s ON v.response_id = s.id
), merged AS (
    SELECT *, body || CASE WHEN version = 1 THEN '<!-- 2 -->' ELSE '' END AS payload FROM judged
)
SELECT id AS record_id, response_id, outcome,
       CASE WHEN outcome = 'validated' THEN
            'cache-control: max-age=3600' || chr(10) || 'content-type: text/html' || chr(10) || 'date: at ' || k || chr(10) ||
            'etag: ' || CASE WHEN tag IS NOT NULL THEN 'W/"' || tag || '"'
                             ELSE '"' || md5(body) || CASE WHEN version = 1 THEN '-2' ELSE '' END || '"' END || chr(10) ||
            'last-modified: day ' || origin END AS headers,
       CASE WHEN outcome = 'validated' THEN sha256(payload) END AS payload_sha256,
       CASE WHEN outcome = 'validated' THEN length(payload) END AS n_chars
FROM merged
"""


@_query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@_query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_table(spark, sf_dir, "documents"))


LLM_ORACLE["op6_exact_dedup"] = """
WITH shas AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM shas WINDOW same AS (PARTITION BY text_sha256)
"""


def _held_out() -> Column:
    """Rows whose labels are not learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    weights = quality.train(docs, labels, allowed=~_held_out())
    scored = quality.score(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@_query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontaminate.find_leaks(docs, items)


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    weights = toxicity.train(docs, labels, allowed=~_held_out())
    scored = toxicity.score(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id",
        _held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "offences",
    )


@_query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_boilerplate")


@_query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def _vector_rounds(rounds: int) -> str:
    """The common table expressions of the rounds, one after the other."""
    return ", ".join(
        f"""
near{k} AS MATERIALIZED (
    SELECT vec_id, p, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM (
        SELECT vec_id, p, e, coalesce(list_sum(list_transform(list_zip(part, entry),
                   lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0)::BIGINT AS d
        FROM parts JOIN book{k} USING (p)
    ) GROUP BY vec_id, p
)""" + (f""", sums{k} AS (
    SELECT p, e, i, sum(part[i])::BIGINT AS s, count(*) AS n
    FROM near{k} JOIN parts USING (vec_id, p), unnest(range(1, len(part) + 1)) AS t(i) GROUP BY p, e, i
), moved{k} AS (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS entry FROM sums{k} GROUP BY p, e
), book{k + 1} AS MATERIALIZED (
    SELECT p, e, coalesce(m.entry, b.entry) AS entry FROM book{k} b LEFT JOIN moved{k} m USING (p, e)
)""" if k < rounds else "")
        for k in range(rounds + 1)
    )


LLM_ORACLE["op11_vector_codes"] = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, p, list_slice(v, p * (len(v) // 8) + 1, (p + 1) * (len(v) // 8)) AS part
    FROM kept, unnest(range(8)) AS t(p)
), book0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry FROM parts
    QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 16
), {_vector_rounds(6)}, codes AS (
    SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near6 GROUP BY vec_id
), digest AS (
    SELECT sha256(string_agg(entry[i]::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
    FROM book6, unnest(range(1, len(entry) + 1)) AS t(i)
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), digest
"""


@_query
def op12_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints_of_edits(_table(spark, sf_dir, "documents"))


def _rebuilt(own: DataFrame) -> DataFrame:
    """Of numbered turns: every conversation begins with up to three turns of the one whose number ends the twenty before."""
    convs = own.select("conv").distinct().select(
        "conv",
        (F.col("conv") - F.col("conv") % 20).alias("of"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).alias("h"),
    )
    turns = own.select(F.col("conv").alias("of"), "pos", "a", "b", "words")
    starts = convs.join(turns.where("pos <= 3"), "of").where("pos <= h").select("conv", "pos", "a", "b", "words")
    n_starts = starts.groupBy("conv").agg(F.count("*").alias("n_start"))
    known = convs.join(n_starts, "conv", "left").select("conv", "h", F.coalesce("n_start", F.lit(0)).alias("n_start"))
    rest = own.join(known, "conv").where("pos > h")
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("n_start")).alias("pos"), "a", "b", "words")
    # Every conversation is there even if nothing is left of it.
    there = convs.select("conv", *(F.lit(None).cast("long").alias(c) for c in ("pos", "a", "b", "words")))
    return starts.unionByName(rest).unionByName(there)


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.numbered(_table(spark, sf_dir, "conversations"))
    return prefix_trie.build(_rebuilt(own)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


# CRC-32 bit by bit: the reversed polynomial for each bit of each character.
LLM_ORACLE["op13_prefix_trie"] = r"""
WITH own AS (
    SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id
                              ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT conv, pos, dense_rank() OVER (ORDER BY role, text) AS id,
           len(regexp_extract_all(text, '[^ 	-
]+')) AS words
    FROM own
), convs AS (
    SELECT conv, conv - conv % 20 AS of,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(conv::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0],
                                          lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv FROM ids)
), starts AS (
    SELECT convs.conv, pos, id, words FROM convs JOIN ids ON ids.conv = convs.of WHERE pos <= h
), rebuilt AS (
    FROM starts UNION ALL
    SELECT ids.conv, pos - h + coalesce(n, 0), id, words
    FROM ids JOIN convs USING (conv) LEFT JOIN (SELECT conv, count(*) AS n FROM starts GROUP BY conv) USING (conv)
    WHERE pos > h
), whole AS (
    SELECT conv, coalesce(list(id ORDER BY pos) FILTER (id IS NOT NULL), []) AS ids,
           coalesce(list(words ORDER BY pos) FILTER (id IS NOT NULL), []) AS words
    FROM convs LEFT JOIN rebuilt USING (conv) GROUP BY conv
), nodes AS (
    SELECT d AS depth, list_slice(ids, 1, d) AS path, min(conv) AS conv_id, count(*) AS n_convs,
           min(CASE WHEN d = 0 THEN 0 ELSE words[d] END) AS words,
           sha256(coalesce(string_agg(CASE WHEN len(ids) = d THEN conv::VARCHAR END, ',' ORDER BY conv), '')) AS ends_sha256
    FROM whole, unnest(range(len(ids) + 1)) AS t(d) GROUP BY depth, path
), children AS (
    SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)
), subtrees AS (
    SELECT list_slice(path, 1, up) AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
           sum((n_convs - 1) * words)::BIGINT AS saved_tokens
    FROM counted, unnest(range(depth + 1)) AS t(up) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM counted n JOIN subtrees USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = list_slice(n.path, 1, n.depth - 1)
"""
