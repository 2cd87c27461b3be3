"""The registered queries: each runs over the driver's whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

from orderloom import functions, plans
from orderloom.operators import metrics, quality, validation
from orderloom.operators.latest import latest_per_key
from orderloom.operators.records import Field, Kind
from orderloom.operators.validation import SchemaValidator, check_field
from orderloom.plans.checks import DECLARED
from orderloom.plans.staging import clean_customers, clean_orders, clean_products
from orderloom.runs import JOBS, IngestRun, build_models, run_all
from orderloom.session import materialize, scratch_path, together
from orderloom.sinks import LoadError, Warehouse
from orderloom.sources import DelimitedSource, JsonPagesSource, Source
from workload import feed
from workload.oracle import RUN_TIME, UPSERT_FROM

Query = Callable[[SparkSession, str], DataFrame]

RAW = {
    "customers": feed.raw_customers,
    "products": feed.raw_products,
    "orders": feed.raw_orders,
}
_RUN_AT = datetime.fromisoformat(RUN_TIME)
_LANDED = {"_loaded_at": "loaded_at", "_source": "source"}
_ORDER_FIELDS = ["order_id", "customer_id", "product_id", "quantity", "order_date", "status"]

QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Shared steps ------------------------------------------------------------------------------------


def portable(df: DataFrame) -> DataFrame:
    """Decimals as double and dates as text, which both engines hand out alike."""

    def plain(field):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DecimalType):
            places = min(field.dataType.scale, 6)
            return F.round(column, places).cast("double").alias(field.name)
        if isinstance(field.dataType, DateType):
            return column.cast("string").alias(field.name)
        return column

    return df.select(*(plain(f) for f in df.schema.fields))


def _valid(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return SchemaValidator("filter").rows(RAW[name](spark, sf_dir), name)


def _staged(spark: SparkSession, sf_dir: str, rows=_valid) -> tuple[DataFrame, ...]:
    return (
        plans.stg_customers(rows(spark, sf_dir, "customers")),
        plans.stg_products(rows(spark, sf_dir, "products")),
        plans.stg_orders(rows(spark, sf_dir, "orders")),
    )


def _unchecked(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return RAW[name](spark, sf_dir)


def _enriched(spark: SparkSession, sf_dir: str, rows=_valid) -> DataFrame:
    customers, products, orders = _staged(spark, sf_dir, rows)
    return plans.int_orders_enriched(orders, customers, products)


def _dim_customers(spark: SparkSession, sf_dir: str, rows=_valid) -> DataFrame:
    customers, products, orders = _staged(spark, sf_dir, rows)
    return plans.dim_customers(customers, plans.priced_orders(orders, products), feed.AS_OF)


def _warehouse(spark: SparkSession) -> Warehouse:
    """A new warehouse in the shared scratch folder."""
    prefix = f"ol_{uuid.uuid4().hex}_"
    return Warehouse(spark, prefix, scratch_path(spark, "warehouse")).create()


def _land(df: DataFrame, path: str) -> str:
    """Write a frame as delimited files, values unchanged."""
    df.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(
        path,
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return path


def _landed_feed(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """Folder with the raw rows of the given tables as input files of an ingestion run."""
    folder = scratch_path(spark, "landing")

    def land(name: str) -> str:
        return _land(RAW[name](spark, sf_dir).drop("_loaded_at", "_source"), f"{folder}/{name}.csv")

    together(spark, *(partial(land, name) for name in names))
    return folder


# Sources -----------------------------------------------------------------------------------------


@_query
def scan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = _warehouse(spark)
    warehouse.load(feed.raw_orders(spark, sf_dir), "orders")
    return warehouse.table("orders")


class _FeedSource(Source):
    """A source of one's own: a frame that is already there."""

    def __init__(self, df: DataFrame):
        super().__init__("feed")
        self.df = df

    def extract(self) -> DataFrame:
        return self.add_metadata(self.df, _RUN_AT)


@_query
def add_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _FeedSource(feed.raw_orders(spark, sf_dir).drop("_loaded_at", "_source"))
    rows = source.extract()
    source.validate_schema(rows, _ORDER_FIELDS)
    return rows


# Written styles besides ISO: slashes, compact, month name, and a moment east of UTC.
_DATE_STYLES = ("MM/dd/yyyy", "yyyyMMdd", "MMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")


@_query
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority, ordered, key = F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")
    text = (
        F.when(priority == "1-URGENT", F.date_format(ordered, "yyyy-MM-dd"))
        .when(priority == "2-HIGH", F.date_format(ordered, _DATE_STYLES[0]))
        .when((priority == "3-MEDIUM") & (key % 4 == 0), F.date_format(ordered, _DATE_STYLES[1]))
        .when((priority == "3-MEDIUM") & (key % 4 == 1), F.date_format(ordered, _DATE_STYLES[2]))
        .when((priority == "3-MEDIUM") & (key % 4 == 2), F.date_format(ordered, _DATE_STYLES[3]))
        .when(priority == "5-LOW", F.concat(F.lit("on "), F.col("o_orderstatus")))
        .when(priority == "4-NOT SPECIFIED", F.lit("n/a"))
        .otherwise(F.date_format(ordered, "yyyy-MM-dd HH:mm:ss"))
    )
    orders = feed.table(spark, sf_dir, "orders")
    path = _land(
        orders.select(
            F.col("o_orderkey").cast("string").alias("order_id"), text.alias("order_date")
        ),
        f"{scratch_path(spark, 'landing')}/orders_feed.csv",
    )
    return DelimitedSource(spark, path, parse_dates=["order_date"]).extract(_RUN_AT)


@_query
def csv_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with line breaks, landed in the order of their ids: records cross splits, and rows are numbered."""
    documents = feed.table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id")
    path = _land(documents, f"{scratch_path(spark, 'landing')}/documents.csv")
    return DelimitedSource(spark, path, number_rows=True).extract(_RUN_AT).drop("_loaded_at", "_source")


@_query
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = feed.table(spark, sf_dir, "documents")
    path = _land(
        documents.select("doc_id", "text", "lang", "source"),
        f"{scratch_path(spark, 'landing')}/documents.csv",
    )
    return DelimitedSource(spark, path, multi_line=True).extract(_RUN_AT)


@_query
def json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page holds one order under ``data``; returned orders make pages without records."""
    order = F.struct(*_ORDER_FIELDS)
    page = F.when(
        F.col("status") == "Returned", F.to_json(F.struct(F.lit("gone").alias("error")))
    ).otherwise(F.to_json(F.struct(F.array(order).alias("data"), F.lit("more").alias("next"))))
    path = scratch_path(spark, "pages")
    feed.raw_orders(spark, sf_dir).select(page.alias("value")).write.text(path)
    return JsonPagesSource(
        spark, path, "orders_api", data_key="data", page_per_line=True
    ).extract(_RUN_AT)


def _as_page(batches):
    """The lines of a partition as one page: a list."""
    started = False
    for batch in batches:
        lines = [("," if started or i else "[") + line for i, line in enumerate(batch.column(0).to_pylist())]
        started = started or bool(lines)
        yield pa.RecordBatch.from_pydict({"value": lines}, pa.schema([("value", pa.string())]))
    yield pa.RecordBatch.from_pydict({"value": ["]" if started else "[]"]})


@_query
def json_large_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in a few large pages, each one list, which are read in splits."""
    order = F.to_json(F.struct(*_ORDER_FIELDS))
    path = scratch_path(spark, "pages")
    feed.raw_orders(spark, sf_dir).select(order.alias("value")).mapInArrow(_as_page, "value string").write.text(path)
    return JsonPagesSource(spark, path, "orders_api", split_pages=True).extract(_RUN_AT)


@_query
def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = Warehouse(spark)
    suffix = uuid.uuid4().hex
    for name in ("orders", "products"):
        warehouse.publish_view(RAW[name](spark, sf_dir), f"{name}_{suffix}")
    return portable(
        warehouse.execute_query(
            f"""SELECT o.status, p.category, p._source AS price_list, count(*) AS n_orders,
                       sum(o.quantity) AS items, sum(o.quantity * p.price) AS revenue
                FROM orders_{suffix} o JOIN products_{suffix} p ON o.product_id = p.product_id
                GROUP BY o.status, p.category, p._source"""
        )
    )


@_query
def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = feed.raw_orders(spark, sf_dir).agg(
        F.to_date(F.min("order_date")).alias("first"), F.to_date(F.max("order_date")).alias("last")
    )
    return portable(functions.spine(days, F.col("first"), F.col("last")))


# Validation --------------------------------------------------------------------------------------


@_query
def validate_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir, "customers")


@_query
def validate_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(_valid(spark, sf_dir, "products"))


@_query
def validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir, "orders")


@_query
def validate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = feed.raw_products(spark, sf_dir)
    return portable(SchemaValidator("flag").rows(raw, "products"))


@_query
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = SchemaValidator("filter").rejects(feed.raw_orders(spark, sf_dir), "orders")
    return rejects.select(F.to_json("_errors").alias("errors"), F.col("_data").alias("data"))


@_query
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of which files were rejected: orders landed in the order of all their columns."""
    rows = feed.raw_orders(spark, sf_dir).select(*_ORDER_FIELDS).orderBy(*_ORDER_FIELDS)
    path = _land(rows, f"{scratch_path(spark, 'landing')}/orders.csv")
    source = DelimitedSource(spark, path, parse_dates=["order_date"], number_rows=True)
    rejects = SchemaValidator("filter").rejects(source.extract(_RUN_AT), "orders")
    return rejects.select("_row_id", F.to_json("_errors").alias("errors"))


@_query
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    validator = SchemaValidator("filter")
    parts = [
        validation.rule_counts(validator.rejects(rows(spark, sf_dir), name)).select(
            F.lit(name).alias("record"), "field", "rule", "n"
        )
        for name, rows in RAW.items()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@_query
def coerce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    amount = (
        F.when(kind == "click", F.col("value").cast("decimal(10,2)").cast("string"))
        .when(kind == "view", user.cast("decimal(10,1)").cast("string"))
        .when(kind == "signup", F.concat(F.lit(" "), user.cast("string"), F.lit(" ")))
        .when(kind == "error", F.col("props"))
    )
    moment = (
        F.when(kind == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "view", F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == "signup", F.col("props"))
    )
    texts = feed.table(spark, sf_dir, "events").select(
        "event_id",
        amount.alias("price"),
        amount.alias("quantity"),
        moment.alias("order_date"),
    )
    price = check_field(Field("price", Kind.MONEY, above=0), texts.schema)
    quantity = check_field(Field("quantity", Kind.WHOLE, above=0), texts.schema)
    ordered = check_field(Field("order_date", Kind.MOMENT, required=False), texts.schema)
    texts = validation.with_parsed(texts, [price, quantity, ordered])
    fits = F.when(quantity.value == F.col("quantity").try_cast("decimal(28,10)"), quantity.value)
    return portable(
        texts.select(
            "event_id",
            price.value.alias("price"),
            fits.cast("double").alias("quantity"),
            ordered.value.alias("order_date"),
            price.error["rule"].alias("price_rule"),
            quantity.error["rule"].alias("quantity_rule"),
            ordered.error["rule"].alias("date_rule"),
        )
    )


# Scalars -----------------------------------------------------------------------------------------


@_query
def string_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_customers(feed.raw_customers(spark, sf_dir))


@_query
def round_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(clean_products(feed.raw_products(spark, sf_dir)))


@_query
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(clean_orders(feed.raw_orders(spark, sf_dir)))


@_query
def coalesce_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(
        _dim_customers(spark, sf_dir).select(
            "customer_id",
            "total_orders",
            "total_items_purchased",
            "lifetime_value",
            "lifetime_profit",
            "completed_orders",
            "unique_categories_purchased",
        )
    )


@_query
def case_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = plans.fct_orders(_enriched(spark, sf_dir))
    return facts.select("order_id", "is_completed", "order_value_tier")


@_query
def activity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _dim_customers(spark, sf_dir)
    return customers.select("customer_id", "last_order_date", "activity_status")


@_query
def margin_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, cost = F.col("price"), F.col("cost")
    return portable(
        feed.raw_products(spark, sf_dir).select(
            "product_id",
            "_source",
            functions.calculate_margin(price, cost).alias("margin"),
            functions.calculate_margin(F.floor(price), F.floor(cost), integral=True).alias(
                "whole_margin"
            ),
        )
    )


@_query
def safe_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")
    return feed.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_extendedprice",
        functions.safe_divide(price, line - 1).alias("plain"),
        functions.safe_divide(price, F.nullif(line, F.lit(7)), default=-1).alias("null_divisor"),
        functions.safe_divide(F.col("l_suppkey"), line - 1, integral=True).alias("whole"),
    )


# Relational --------------------------------------------------------------------------------------


@_query
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(feed.raw_orders(spark, sf_dir), ["order_id"])


@_query
def orders_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(_enriched(spark, sf_dir))


def _order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced orders before de-duplication: order ids repeat, so distinct counts matter."""
    orders, products = _valid(spark, sf_dir, "orders"), _valid(spark, sf_dir, "products")
    return plans.priced_orders(orders, plans.stg_products(products))


@_query
def customer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(metrics.customer_metrics(_order_versions(spark, sf_dir)))


@_query
def product_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(metrics.product_metrics(_order_versions(spark, sf_dir)))


# Models ------------------------------------------------------------------------------------------


@_query
def stg_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.stg_customers(feed.raw_customers(spark, sf_dir))


@_query
def stg_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(plans.stg_products(feed.raw_products(spark, sf_dir)))


@_query
def stg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(plans.stg_orders(feed.raw_orders(spark, sf_dir)))


@_query
def fct_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(plans.fct_orders(_enriched(spark, sf_dir)))


@_query
def dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(_dim_customers(spark, sf_dir))


@_query
def dim_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = plans.stg_products(_valid(spark, sf_dir, "products"))
    orders = plans.stg_orders(_valid(spark, sf_dir, "orders"))
    return portable(plans.dim_products(products, plans.priced_orders(orders, products)))


# Loads and runs ----------------------------------------------------------------------------------


@_query
def load_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replaced table holds the last frame only, with that frame's columns."""
    warehouse = _warehouse(spark)
    rows = feed.raw_products(spark, sf_dir)
    warehouse.load(rows, "products")
    warehouse.load(rows, "products", if_exists="replace")
    return portable(warehouse.table("products"))


@_query
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders loaded up to a day are in the table; all later versions of orders are upserted."""
    warehouse = _warehouse(spark)
    rows, cutoff = feed.raw_orders(spark, sf_dir), F.lit(UPSERT_FROM).cast("timestamp_ntz")
    early = rows.where(F.col("_loaded_at") < cutoff)
    warehouse.load(latest_per_key(early, ["order_id"]), "orders")
    warehouse.upsert(
        rows.where(F.col("_loaded_at") >= cutoff),
        "orders",
        "raw",
        key_columns=["order_id"],
        update_columns=["quantity", "status", "_loaded_at"],
        order_by=["_loaded_at", "customer_id", "product_id", "quantity", "order_date", "status"],
    )
    return warehouse.table("orders")


@_query
def upsert_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes as in ``upsert``, from files: the later line of a key wins, no column says so."""
    warehouse = _warehouse(spark)
    rows, cutoff = feed.raw_orders(spark, sf_dir), F.lit(UPSERT_FROM).cast("timestamp_ntz")
    warehouse.load(latest_per_key(rows.where(F.col("_loaded_at") < cutoff), ["order_id"]), "orders")
    order = ["_loaded_at", "customer_id", "product_id", "quantity", "order_date", "status"]
    late = rows.where(F.col("_loaded_at") >= cutoff).orderBy("order_id", *order).withColumnsRenamed(_LANDED)
    path = _land(late, f"{scratch_path(spark, 'landing')}/changes.csv")
    changes = DelimitedSource(spark, path, number_rows=True).extract().drop("_loaded_at", "_source")
    warehouse.upsert(
        changes.withColumnsRenamed({given: name for name, given in _LANDED.items()}),
        "orders",
        "raw",
        key_columns=["order_id"],
        update_columns=["quantity", "status", "_loaded_at"],
    )
    return warehouse.table("orders")


@_query
def ingest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = _warehouse(spark)
    jobs = [job for job in JOBS if job.name == "orders"]
    IngestRun(warehouse, _landed_feed(spark, sf_dir, "orders"), jobs, loaded_at=_RUN_AT).run()
    return warehouse.table("orders")


@_query
def ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _landed_feed(spark, sf_dir, *RAW)
    report = IngestRun(_warehouse(spark), folder, loaded_at=_RUN_AT).run()
    return spark.createDataFrame(
        [(report.tables_processed, report.rows_loaded, report.rows_rejected, len(report.errors))],
        "tables_processed int, rows_loaded bigint, rows_rejected bigint, n_errors int",
    )


@_query
def rerun_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer dimension after the same files were ingested twice."""
    warehouse, folder = _warehouse(spark), _landed_feed(spark, sf_dir, *RAW)
    for _ in range(2):
        IngestRun(warehouse, folder).run()
    return portable(build_models(warehouse, feed.AS_OF)["marts.dim_customers"])


# Quality -----------------------------------------------------------------------------------------


@_query
def test_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_null_failures(feed.raw_orders(spark, sf_dir), "customer_id")


@_query
def test_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unique_failures(feed.raw_orders(spark, sf_dir), "order_id")


@_query
def test_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, products, orders = _staged(spark, sf_dir)
    return quality.relationship_failures(orders, "product_id", products, "product_id")


@_query
def test_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = ["pending", "shipped", "completed", "cancelled"]
    return quality.accepted_value_failures(feed.raw_orders(spark, sf_dir), "status", statuses)


@_query
def test_ltv_non_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _dim_customers(spark, sf_dir, _unchecked).where("lifetime_value < 0")
    return portable(customers.select("customer_id", "lifetime_value"))


@_query
def test_order_totals_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = plans.fct_orders(_enriched(spark, sf_dir, _unchecked)).where("order_total <= 0")
    return portable(facts.select("order_id", "order_total"))


@_query
def dq_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = _warehouse(spark)
    for name in RAW:
        warehouse.load(_valid(spark, sf_dir, name), name)
    return quality.run_suite(build_models(warehouse, feed.AS_OF), DECLARED)


# Outcomes ----------------------------------------------------------------------------------------


@_query
def validate_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strict validation says of all rows, ordered by every column, and of the valid ones."""
    lines = []
    for name in RAW:
        raw, strict = RAW[name](spark, sf_dir), SchemaValidator("strict")
        for kind, rows in (("raw", raw.orderBy(*raw.columns)), ("valid", _valid(spark, sf_dir, name))):
            try:
                lines.append((name, kind, "accepted", strict.rows(rows, name).count()))
            except ValueError as error:
                lines.append((name, kind, str(error), 0))
    return spark.createDataFrame(lines, "record string, given string, outcome string, n_rows bigint")


@_query
def absent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that come without the optional date: it is added as null."""
    return SchemaValidator("filter").rows(feed.raw_orders(spark, sf_dir).drop("order_date"), "orders")


@_query
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that come without customer and status: every row breaks the rule."""
    rows = feed.raw_orders(spark, sf_dir).drop("customer_id", "status")
    return validation.rule_counts(SchemaValidator("filter").rejects(rows, "orders"))


@_query
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each raw table has the columns of each record, and how many rows it has."""
    validator, lines = SchemaValidator(), []
    for name in RAW:
        source = _FeedSource(RAW[name](spark, sf_dir))
        rows = source.extract()
        n_rows = rows.count()
        for record in RAW:
            try:
                source.validate_schema(rows, validator.get_schema_columns(record))
                lines.append((name, record, "complete", n_rows))
            except ValueError as error:
                lines.append((name, record, str(error), n_rows))
    return spark.createDataFrame(lines, "given string, record string, outcome string, n_rows bigint")


@_query
def json_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order with a record per line; records differ in their keys, some pages have none."""
    rows = feed.raw_orders(spark, sf_dir)
    record = F.struct(
        "order_id",
        "product_id",
        "quantity",
        F.when(F.col("quantity") > 1, F.col("status")).alias("status"),
        F.when(F.col("quantity") == 12, "gift").alias("extra"),
    )
    pages = rows.groupBy("order_id").agg(F.collect_list(record).alias("data"), F.max("quantity").alias("most"))
    empty = F.to_json(F.struct(F.array().cast("array<string>").alias("data")))
    page = F.when(F.col("most") <= 1, empty).otherwise(F.to_json(F.struct("data")))
    path = scratch_path(spark, "pages")
    pages.select(page.alias("value")).write.text(path)
    return JsonPagesSource(spark, path, "orders_api", data_key="data", page_per_line=True).extract(_RUN_AT)


@_query
def load_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads that create, refuse, or change nothing: rows written and rows in the table after each."""
    warehouse, rows = _warehouse(spark), feed.raw_orders(spark, sf_dir)
    none, lines = rows.where("false"), []
    steps = (
        ("fail, new", rows, "fail"),
        ("fail, exists", rows, "fail"),
        ("fail, exists, empty", none, "fail"),
        ("append, empty", none, "append"),
        ("replace, empty", none, "replace"),
        ("append", rows, "append"),
    )
    for step, frame, mode in steps:
        try:
            outcome, written = "loaded", warehouse.load(frame, "lines", if_exists=mode)
        except LoadError:
            outcome, written = "refused", 0
        lines.append((step, outcome, written, warehouse.table("lines").count()))
    return spark.createDataFrame(lines, "step string, outcome string, written bigint, in_table bigint")


@_query
def ingest_broken_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in which one file has a row that is too long: that job fails whole, the others go on."""
    warehouse, folder = _warehouse(spark), _landed_feed(spark, sf_dir, *RAW)
    header = ",".join(_ORDER_FIELDS)
    broken = spark.range(1, numPartitions=1).select(F.lit(f"{header}\n1,2,3,4,5,6,7").alias("value"))
    broken.write.mode("append").text(f"{folder}/orders.csv")
    report = IngestRun(warehouse, folder, loaded_at=_RUN_AT).run()
    jobs = {e["job"] for e in report.errors}
    lines = [(name, name in jobs, warehouse.table(name).count()) for name in RAW]
    tables = spark.createDataFrame(lines, "job string, failed boolean, in_table bigint")
    return tables.select(
        "*",
        F.lit(report.tables_processed).alias("tables_processed"),
        F.lit(report.rows_loaded).cast("bigint").alias("rows_loaded"),
        F.lit(report.rows_rejected).cast("bigint").alias("rows_rejected"),
        F.lit(int(report.failed)).alias("exit_status"),
    )


@_query
def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion, models and data tests in one call: the tests that failed, with the run's counts."""
    outcome = run_all(_warehouse(spark), _landed_feed(spark, sf_dir, *RAW), feed.AS_OF)
    failed = [(t["test"], t["table"], t["column"], t["failures"]) for t in outcome.failed_tests]
    lines = spark.createDataFrame(
        [*failed, ("run", "", "", int(outcome.succeeded))],
        "test string, `table` string, `column` string, failures bigint",
    )
    return lines.select(
        "*",
        F.lit(outcome.ingestion.rows_loaded).cast("bigint").alias("rows_loaded"),
        F.lit(outcome.ingestion.rows_rejected).cast("bigint").alias("rows_rejected"),
    )


@_query
def publish_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order fact by year and month, published twice and read back."""
    warehouse = _warehouse(spark)
    # Two tables are built from the fact, so it is computed once.
    facts = materialize(plans.fct_orders(_enriched(spark, sf_dir)), "facts")
    for _ in range(2):
        warehouse.publish(facts, "fct_orders", "marts", ("order_year", "order_month"))
    return portable(warehouse.table("fct_orders", "marts"))


@_query
def upsert_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes as in ``upsert``, to a table by status: rows move between partitions."""
    warehouse = _warehouse(spark)
    rows, cutoff = feed.raw_orders(spark, sf_dir), F.lit(UPSERT_FROM).cast("timestamp_ntz")
    early = latest_per_key(rows.where(F.col("_loaded_at") < cutoff), ["order_id"])
    warehouse.publish(early, "orders", "marts", ["status"])
    warehouse.upsert(
        rows.where(F.col("_loaded_at") >= cutoff),
        "orders",
        "marts",
        key_columns=["order_id"],
        update_columns=["quantity", "status", "_loaded_at"],
        order_by=["_loaded_at", "customer_id", "product_id", "quantity", "order_date", "status"],
    )
    return warehouse.table("orders", "marts")
