"""Plans and results under conditions that matter at scale: hot keys, pruning, one pass."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from orderloom import plans
from orderloom.operators import quality
from orderloom.operators.latest import latest_per_key
from orderloom.operators.validation import SchemaValidator
from orderloom.sinks import Warehouse
from orderloom.sources import DelimitedSource
from workload.catalog import QUERIES

N_ORDERS = 240_000


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for key, value in names.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Raw tables in which one customer and one product have a third of all orders."""
    folder = tmp_path_factory.mktemp("hot")
    number = F.col("id")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def key(prefix, count):
        other = F.concat(F.lit(prefix), (F.xxhash64("id") % count).cast("string"))
        return F.when(number % 3 == 0, prefix + "HOT").otherwise(other)

    frames = {
        "orders": spark.range(N_ORDERS).select(
            F.concat(F.lit("O"), number).alias("order_id"),
            key("C", 5000).alias("customer_id"),
            key("P", 3000).alias("product_id"),
            F.lit(2).alias("quantity"),
            F.timestamp_seconds(number + 1_700_000_000).cast("timestamp_ntz").alias("order_date"),
            F.lit("completed").alias("status"),
            stamp.alias("_loaded_at"),
            F.lit("s").alias("_source"),
        )
    }
    people = frames["orders"].select("customer_id").distinct()
    frames["customers"] = people.select(
        "customer_id", F.lit("Ann").alias("first_name"), F.lit("Lee").alias("last_name"),
        F.concat("customer_id", F.lit("@b.de")).alias("email"), F.lit("DE").alias("country"),
        stamp.alias("created_at"), stamp.alias("_loaded_at"), F.lit("s").alias("_source"),
    )
    items = frames["orders"].select("product_id").distinct()
    frames["products"] = items.select(
        "product_id", F.lit("Lamp").alias("product_name"), F.lit("Home").alias("category"),
        F.lit(10).cast("decimal(10,2)").alias("price"), F.lit(4).cast("decimal(10,2)").alias("cost"),
        stamp.alias("_loaded_at"), F.lit("s").alias("_source"),
    )
    tables = {}
    for name, df in frames.items():
        df.write.parquet(str(folder / name))
        tables[name] = spark.read.parquet(str(folder / name))
    return tables


SKEW = dict(
    spark__sql__autoBroadcastJoinThreshold="-1",
    spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
    spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    spark__sql__adaptive__advisoryPartitionSizeInBytes="128KB",
    spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
    spark__sql__shuffle__partitions="32",
)


def test_hot_keys_are_split_in_both_lookups(spark, hot):
    """With broadcast ruled out, the oversized partitions of both joins are split."""
    with settings(spark, **SKEW):
        enriched = plans.int_orders_enriched(
            plans.stg_orders(hot["orders"]),
            plans.stg_customers(hot["customers"]),
            plans.stg_products(hot["products"]),
        )
        rows = enriched.collect()
        text = enriched._jdf.queryExecution().executedPlan().toString()
        final = text.split("== Initial Plan ==")[0]
        assert len(re.findall(r"SortMergeJoin\(skew=true\)", final)) == 2, final
    assert len(rows) == N_ORDERS
    assert len({r.order_id for r in rows}) == N_ORDERS
    assert sum(r.customer_id == "CHOT" for r in rows) == N_ORDERS // 3
    assert all(r.customer_name and r.product_name for r in rows)


def test_hot_product_is_split_before_its_metrics(spark, hot):
    """Grouping by the join key right after the join does not keep the join from being split."""
    with settings(spark, **SKEW):
        products = plans.stg_products(hot["products"])
        lines = plans.priced_orders(plans.stg_orders(hot["orders"]), products)
        dim = plans.dim_products(products, lines)
        rows = dim.collect()
        text = dim._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in text.split("== Initial Plan ==")[0]
    assert sum(r.total_orders for r in rows) == N_ORDERS


def test_orders_without_customer_are_split_too(spark, hot):
    """Null keys gather in one partition like a hot key; none of their rows is lost."""
    with settings(spark, **SKEW):
        guest = F.col("customer_id") != "CHOT"
        orders = plans.stg_orders(
            hot["orders"].withColumn("customer_id", F.when(guest, F.col("customer_id")))
        )
        enriched = plans.int_orders_enriched(
            orders, plans.stg_customers(hot["customers"]), plans.stg_products(hot["products"])
        )
        rows = enriched.collect()
        text = enriched._jdf.queryExecution().executedPlan().toString()
        assert text.split("== Initial Plan ==")[0].count("SortMergeJoin(skew=true)") == 2
    assert len(rows) == N_ORDERS
    assert sum(r.customer_id is None for r in rows) == N_ORDERS // 3
    assert all(r.customer_name is None for r in rows if r.customer_id is None)


def test_hot_customer_metrics_are_whole(spark, hot):
    orders = plans.stg_orders(hot["orders"])
    products = plans.stg_products(hot["products"])
    customers = plans.stg_customers(hot["customers"])
    lines = plans.priced_orders(orders, products)
    top = plans.dim_customers(customers, lines).orderBy(F.desc("total_orders")).first()
    assert (top.customer_id, top.total_orders) == ("CHOT", N_ORDERS // 3)
    assert top.lifetime_value == 20 * N_ORDERS // 3 and top.completed_orders == N_ORDERS // 3
    best = plans.dim_products(products, lines).orderBy(F.desc("total_orders")).first()
    assert (best.product_id, best.total_orders) == ("PHOT", N_ORDERS // 3)
    buyers = hot["orders"].where("product_id = 'PHOT'").select("customer_id").distinct().count()
    assert best.unique_customers == buyers


def shuffled_rows(spark, df) -> list[int]:
    """Rows written by each shuffle of a query, from the metrics of its final plan."""
    df.collect()
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            stack.append(node.plan())
            continue
        if name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.length()))
    return found


def test_a_hot_key_is_reduced_before_the_shuffle(spark, hot):
    """A key with many versions sends one row per task, whatever its share of the rows."""
    tasks = hot["orders"].rdd.getNumPartitions()
    versions = latest_per_key(hot["orders"], ["customer_id"])
    keys = versions.count()
    assert max(shuffled_rows(spark, versions)) <= keys * tasks
    counted = quality.unique_failures(hot["orders"], "customer_id")
    assert max(shuffled_rows(spark, counted)) <= keys * tasks
    orphans = quality.relationship_failures(
        hot["orders"], "customer_id", hot["customers"].where("customer_id <> 'CHOT'"), "customer_id"
    )
    assert max(shuffled_rows(spark, orphans)) <= keys * tasks
    assert [tuple(r) for r in orphans.collect()] == [("CHOT", N_ORDERS // 3)]


def test_compared_versions_are_put_together_once(spark, hot):
    """The struct that is compared is a column below the aggregates, which only refer to it."""
    latest = latest_per_key(hot["orders"], ["order_id"])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("max(_latest") == 2 and "max(struct(" not in plan


def test_metrics_use_one_distinct_column(spark, hot):
    lines = plans.priced_orders(plans.stg_orders(hot["orders"]), plans.stg_products(hot["products"]))
    for dim in (
        plans.dim_customers(plans.stg_customers(hot["customers"]), lines),
        plans.dim_products(plans.stg_products(hot["products"]), lines),
    ):
        assert "Expand" not in plan(dim)


def test_dimensions_do_not_read_the_other_dimension(spark, hot):
    lines = plans.priced_orders(plans.stg_orders(hot["orders"]), plans.stg_products(hot["products"]))
    dim = plans.dim_products(plans.stg_products(hot["products"]), lines)
    assert plan(dim).split("== Physical Plan ==")[1].count("country") == 0


def test_unused_lookup_is_dropped_by_the_optimizer(spark, hot):
    """Staged keys are known to be unique, so joins nobody reads from disappear."""
    enriched = plans.int_orders_enriched(
        plans.stg_orders(hot["orders"]),
        plans.stg_customers(hot["customers"]),
        plans.stg_products(hot["products"]),
    )
    physical = plan(enriched.select("order_id", "unit_price")).split("== Physical Plan ==")[1]
    assert physical.count("Join") == 1


def test_scans_read_only_the_columns_they_need(spark, hot):
    priced = plans.stg_products(hot["products"]).where("product_id = 'PHOT'").select("price")
    assert "EqualTo(product_id,PHOT)" in plan(priced)
    counted = quality.unique_failures(hot["orders"], "order_id")
    assert "ReadSchema: struct<order_id:string>" in plan(counted)


def test_no_python_on_the_workers_and_no_cross_joins(spark, hot):
    valid = SchemaValidator().validate(hot["orders"], "orders")[0]
    frames = [
        valid,
        SchemaValidator("flag").validate(hot["orders"], "orders")[0],
        plans.fct_orders(
            plans.int_orders_enriched(
                plans.stg_orders(valid),
                plans.stg_customers(hot["customers"]),
                plans.stg_products(hot["products"]),
            )
        ),
    ]
    for df in frames:
        physical = plan(df).split("== Physical Plan ==")[1]
        for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in physical


def test_validation_needs_no_shuffle(spark, hot):
    for mode in ("filter", "flag"):
        rows, rejects = SchemaValidator(mode).validate(hot["orders"], "orders")
        assert "Exchange" not in plan(rows) and "Exchange" not in plan(rejects)


def test_loads_count_while_they_write(spark, hot, tmp_path):
    """One job writes and counts; nothing is counted separately."""
    warehouse = Warehouse(spark, "scale_one_pass_", str(tmp_path)).create()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-pass", "load")
    checked = SchemaValidator().check(hot["orders"], "orders")
    assert warehouse.load(checked.rows, "orders") == N_ORDERS
    assert checked.counts.get == {"valid": N_ORDERS, "rejected": 0}
    jobs = tracker.getJobIdsForGroup("one-pass")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1


def test_large_files_are_split_between_tasks(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("a,b\n" + "\n".join(f"{i},x{i}" for i in range(20_000)) + "\n")
    with settings(
        spark,
        spark__sql__files__maxPartitionBytes="64KB",
        spark__sql__files__openCostInBytes="1",
    ):
        df = DelimitedSource(spark, str(path)).extract()
        assert df.rdd.getNumPartitions() > 2
        assert df.count() == 20_000
        assert df.select("a").distinct().count() == 20_000


def test_upsert_of_few_changes_does_not_shuffle_the_table(spark, hot, tmp_path):
    from orderloom.operators.upsert import merge_rows, reduce_changes

    target, keys = hot["orders"], ["order_id"]
    few = target.limit(50).withColumn("status", F.lit("pending"))
    # As the upsert stages them: their size is known.
    reduce_changes(few, few.columns, keys, ["status"], ["_loaded_at"]).write.parquet(str(tmp_path / "changes"))
    changes = spark.read.parquet(str(tmp_path / "changes"))
    merged = merge_rows(target, changes, few.columns, keys, ["status"], {})
    assert merged.count() == N_ORDERS
    # Only changes and their keys are shuffled, never rows of the table.
    assert max(shuffled_rows(spark, merged.select("*")), default=0) <= 50


def test_upsert_keeps_null_keys_out_of_the_join(spark, tmp_path):
    """A table in which a third of the rows have no key: none is lost, none is shuffled."""
    warehouse = Warehouse(spark, "scale_null_keys_", str(tmp_path)).create()
    key = F.when(F.col("id") % 3 != 0, F.concat(F.lit("K"), "id"))
    warehouse.load(spark.range(30_000).select(key.alias("k"), F.col("id").alias("v")), "t")
    changes = spark.createDataFrame([("K1", -1), ("new", -2), (None, -3)], "k string, v bigint")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        assert warehouse.upsert(changes, "t", "raw", ["k"], order_by=["v"]) == 3
    table = warehouse.table("t")
    assert table.count() == 30_002 and table.where("k is null").count() == 10_001
    assert {r.v for r in table.where("k = 'K1' or k = 'new' or v = -3").collect()} == {-1, -2, -3}

    from orderloom.operators.upsert import merge_rows, reduce_changes

    reduced = reduce_changes(changes, ["k", "v"], ["k"], ["v"], ["v"])
    merged = merge_rows(table, reduced, ["k", "v"], ["k"], ["v"], {})
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        assert max(shuffled_rows(spark, merged.select("*"))) <= 20_002


def test_hot_key_in_upsert(spark, tmp_path):
    """A third of the changes hit one key; the last one wins and all others arrive."""
    warehouse = Warehouse(spark, "scale_upsert_", str(tmp_path)).create()
    start = spark.range(1000).select(
        F.concat(F.lit("K"), "id").alias("k"), F.lit(-1).cast("bigint").alias("v")
    )
    warehouse.load(start, "t")
    key = F.when(F.col("id") % 3 == 0, "K0").otherwise(F.concat(F.lit("K"), F.col("id") % 2000))
    changes = spark.range(90_000).select(key.alias("k"), F.col("id").alias("v"))
    assert warehouse.upsert(changes, "t", "raw", ["k"], order_by=["v"]) == 90_000
    got = {r.k: r.v for r in warehouse.table("t").collect()}
    expected = {f"K{i}": -1 for i in range(1000)}
    for i in range(90_000):
        expected["K0" if i % 3 == 0 else f"K{i % 2000}"] = i
    assert got == expected


def test_several_distinct_counts_do_not_copy_rows(spark, hot):
    """Orders are not known to be unique: still no Expand, and a hot customer's rows are reduced before the last shuffle."""
    from orderloom.operators import metrics

    priced = plans.priced_orders(hot["orders"], plans.stg_products(hot["products"]))
    for totals in (metrics.customer_metrics(priced), metrics.product_metrics(priced)):
        assert "Expand" not in totals._jdf.queryExecution().executedPlan().toString()
    key = metrics._per_value(priced, "customer_id", "product_category")
    assert "hashpartitioning(customer_id" in key._jdf.queryExecution().executedPlan().toString()


def test_the_fact_that_is_published_twice_is_computed_once(spark, monkeypatch):
    plans_seen, publish = [], Warehouse.publish

    def noted(self, df, *args):
        plans_seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return publish(self, df, *args)

    monkeypatch.setattr(Warehouse, "publish", noted)
    QUERIES["publish_partitioned"](spark, "/root/testdata/sf0.001")
    assert len(plans_seen) == 2
    assert not any("Join" in plan or "Aggregate" in plan for plan in plans_seen)
