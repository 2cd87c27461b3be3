"""Not-modified revisits of a web archive, resolved to the responses that they stand for.

A revisit record says that a page had not changed when it was fetched again, and has no content of its own. It
is joined as of its time to the latest earlier full response (status 200) for the same canonical URL. Its
validators are checked against that response; if they do not contradict, the result has the
response's payload and headers, with the revisit's headers in place of the response's, except for those that a
not-modified answer may not change.

The as-of join sorts all records by URL and time over range partitions, so that a URL with any share of all
records lies across as many of them as it needs. Within a partition the latest response is carried
forward; of every partition's URLs that go on in the next one, as many as there are partitions, the last response
is handed on. Payloads are not moved for that: they are fetched by record id afterwards.

Canonical URL: without scheme, user, ``www.``, default port, fragment, tracking parameters and trailing
slash; host in lower case; parameters sorted.

Validators: entity tags are compared weakly (without ``W/``); if the revisit has none, its
Last-Modified must be the response's. Outcomes: ``validated`` (they agree), ``unchecked`` (one side has none),
``mismatch`` (they differ: nothing is merged), ``unmatched`` (no earlier full response).

Defined results: a record without an id is left out; a null URL or time matches nothing; null headers are none, and of repeated names the last
counts; records at the same time are not earlier than each other, and of responses at one time the one
with the largest id serves; of records that share an id, the earliest counts, then that with the
smallest URL; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import shuffle_partitions, stored

#: A response that many revisits stand for is joined in parts, from this share of an average partition.
HOT_SHARE, HOT_REVISITS = 0.25, 64

# Parameters that do not choose content, and headers that belong to the stored payload or to one connection
# (RFC 9111, 3.1 and 3.2).
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)"
KEPT_HEADERS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)


def canonical_url(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    wanted = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^{TRACKING}(=|$)"))
    query = F.array_join(F.array_sort(wanted), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def header_map(headers: Column) -> Column:
    """Headers (an array of name, value) as a map by lower-case name; of repeated names the last counts."""
    empty = F.expr("map()").cast("map<string,string>")
    named = F.filter(headers, lambda h: h["name"].isNotNull())
    lowered = F.transform(named, lambda h: F.lower(F.trim(h["name"])))
    last = F.filter(
        F.transform(
            named,
            lambda h, i: F.struct(F.lower(F.trim(h["name"])).alias("key"), h["value"].alias("value"), i.alias("i")),
        ),
        lambda e: ~F.array_contains(F.slice(lowered, e["i"] + 2, F.size(lowered)), e["key"]),
    )
    return F.coalesce(F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"]))), empty)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def outcome(revisit: Column, response: Column) -> Column:
    """What the validators of two header maps say."""
    tags = [_strong(F.try_element_at(h, F.lit("etag"))) for h in (revisit, response)]
    dates = [F.trim(F.try_element_at(h, F.lit("last-modified"))) for h in (revisit, response)]
    ours, theirs = (F.when(tags[0].isNotNull(), t).otherwise(d) for t, d in zip(tags, dates, strict=True))
    return (
        F.when(response.isNull(), "unmatched")
        .when(ours.isNull() | theirs.isNull(), "unchecked")
        .when(ours == theirs, "validated")
        .otherwise("mismatch")
    )


def merged_headers(revisit: Column, response: Column) -> Column:
    """The response's headers, with those of the revisit that may change them in their place."""
    new = F.map_filter(revisit, lambda name, _: ~name.isin(*KEPT_HEADERS))
    old = F.map_filter(response, lambda name, _: ~F.array_contains(F.map_keys(new), name))
    return F.map_concat(old, new)


def as_of_responses(records: DataFrame) -> DataFrame:
    """Of (id, url, at, full, revisit) rows: for each revisit its id and the id of the latest earlier full
    response for the url, or null."""
    order = [F.col("url"), F.col("at"), F.col("full"), F.col("id")]  # revisits before responses of their time
    ranges = stored(
        records.where("(full or revisit) and url is not null and at is not null")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()),
        "warc-ranges",
    )
    full_id = F.when(F.col("full"), F.struct("at", "id"))
    so_far = Window.partitionBy("url", "part").orderBy("at", "full", "id")
    here = ranges.withColumn("here", F.last(full_id, ignorenulls=True).over(so_far)).where("revisit")
    # URLs that lie in several partitions: each goes through whole partitions, so there are at most twice as
    # many such rows as partitions.
    pieces = ranges.groupBy("url", "part").agg(F.max(full_id).alias("last"))
    across = ranges.groupBy("url").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    before = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last_before = F.last("last", ignorenulls=True).over(before).alias("before")
    handed = stored(pieces.join(F.broadcast(across), "url").select("url", "part", last_before), "warc-handed-on")
    joined = here.join(F.broadcast(handed), ["url", "part"], "left")
    return joined.select("id", F.coalesce(F.col("here.id"), F.col("before.id")).alias("response_id"))


def _salted(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches with a salt, the responses that many revisits use and into how many parts those are dealt)."""
    limit = max(HOT_REVISITS, int(matched.count() / shuffle_partitions(matched.sparkSession) * HOT_SHARE))
    # At most revisits / limit = partitions / HOT_SHARE rows.
    ranges = stored(
        matched.where("response_id is not null").groupBy("response_id").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        .select(F.col("response_id").alias("hot_id"), F.ceil(F.col("n") / limit).cast("int").alias("n_parts")),
        "warc-hot-responses",
    )
    salt = F.when(F.col("n_parts").isNotNull(), F.pmod(F.xxhash64("id"), "n_parts")).otherwise(0).cast("int")
    salted = matched.join(F.broadcast(ranges), F.col("response_id") == F.col("hot_id"), "left").select(
        F.col("id").alias("of"), "response_id", salt.alias("salt")
    )
    return salted, ranges


def resolve(
    records: DataFrame,
    id_col: str = "record_id",
    type_col: str = "warc_type",
    uri_col: str = "target_uri",
    date_col: str = "warc_date",
    status_col: str = "status",
    headers_col: str = "headers",
    payload_col: str = "payload",
) -> DataFrame:
    """One row per revisit: id, response_id, outcome, headers (a map), payload; the last two null unless the
    outcome is validated or unchecked."""
    kind = F.lower(F.col(f"`{type_col}`"))
    own = records.select(
        F.col(f"`{id_col}`").alias("id"),
        canonical_url(F.col(f"`{uri_col}`")).alias("url"),
        F.col(f"`{uri_col}`").alias("uri"),
        F.col(f"`{date_col}`").alias("at"),
        F.coalesce((kind == "response") & (F.col(f"`{status_col}`") == 200), F.lit(False)).alias("full"),
        F.coalesce(kind == "revisit", F.lit(False)).alias("revisit"),
        F.col(f"`{headers_col}`").alias("headers"),
        F.col(f"`{payload_col}`").alias("payload"),
    ).where("(full or revisit) and id is not null")

    def once(rows: DataFrame, *by: str) -> DataFrame:
        first = Window.partitionBy(*by).orderBy(F.col("at").asc_nulls_last(), F.col("uri").asc_nulls_last())
        return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "uri")

    matched = stored(as_of_responses(once(own.drop("headers", "payload"), "id", "full")), "warc-matches")
    salted, ranges = _salted(matched)
    revisits = once(own.where("revisit").drop("payload"), "id").join(salted, F.col("id") == F.col("of"), "left")
    # Those without a response match nothing; the salt spreads them over the join's tasks.
    alone = F.col("response_id").isNull()
    revisits = revisits.withColumn("salt", F.when(alone, F.hash("id")).otherwise(F.col("salt")))
    # Salted before they are made unique, so payloads are shuffled once: by what they are joined by.
    dealt = (
        own.where("full")
        .join(F.broadcast(ranges), F.col("id") == F.col("hot_id"), "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("n_parts", F.lit(1)) - 1)))
    )
    responses = once(dealt, "id", "part").select(
        F.col("id").alias("source_id"), "part", header_map(F.col("headers")).alias("old"), F.col("payload").alias("found")
    )
    joined = revisits.withColumn("new", header_map(F.col("headers"))).join(
        responses, (F.col("response_id") == F.col("source_id")) & (F.col("salt") == F.col("part")), "left"
    )
    judged = joined.withColumn("outcome", outcome(F.col("new"), F.col("old")))
    good = F.col("outcome").isin("validated", "unchecked")
    return judged.select(
        F.col("id").alias(id_col),
        "response_id",
        "outcome",
        F.when(good, merged_headers(F.col("new"), F.col("old"))).alias("headers"),
        F.when(good, F.col("found")).alias("payload"),
    )
