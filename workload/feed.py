"""The driver's tables mapped onto the raw schemas, whole and without samples.

Customers and suppliers are customers; parts and one support contract per supplier are products;
the lines of an order are successive versions of it. Every customer and part is sent twice, so the
latest row has to be found, and some values break the record rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"
FIRST_LOAD = "2001-01-01 00:00:00"
SECOND_LOAD = "2001-02-01 00:00:00"
OLD_LOAD = "2000-06-01 00:00:00"
SIGN_UP = "1995-01-01 00:00:00"


# Columns of the driver's tables. Given, so that no file is opened to plan a query.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    country = "if(n_name = 'NATION_7', 'X', n_name{space})"
    first = _customer(
        "'C' || c_custkey",
        "' ' || c_mktsegment || ' '",
        "substr(c_name, 10)",
        "if(c_acctbal < -500, 'bad-email', "
        "if(c_acctbal < -200, null, 'User.' || c_custkey || '@Mail.com'))",
        country.format(space=" || ' '"),
        _ts(FIRST_LOAD),
        "load1",
    )
    second = _customer(
        "'C' || c_custkey",
        "lower(c_mktsegment)",
        "substr(c_name, 10)",
        "'New.' || c_custkey || '@Mail.com'",
        country.format(space=""),
        f"""case c_mktsegment when 'BUILDING' then null when 'MACHINERY' then {_ts(OLD_LOAD)}
            when 'AUTOMOBILE' then {_ts(FIRST_LOAD)} else {_ts(SECOND_LOAD)} end""",
        "load2",
    )
    business = _customer(
        "'S' || s_suppkey",
        "'Supplier'",
        "substr(s_name, 10)",
        "'Sales.' || s_suppkey || '@Supplier.com'",
        "n_name",
        _ts(FIRST_LOAD),
        "load1",
    )
    customers = table(spark, sf_dir, "customer").join(nation, F.expr("c_nationkey = n_nationkey"))
    suppliers = table(spark, sf_dir, "supplier").join(nation, F.expr("s_nationkey = n_nationkey"))
    return _rows(customers, first, second).unionAll(_rows(suppliers, business))


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    above_base = "cast(cast(p_retailprice as decimal(10,2)) - 900 as decimal(10,2))"
    parts = table(spark, sf_dir, "part").withColumn(
        "spread", F.expr(f"cast({above_base} * p_size * p_size * 0.001BD as decimal(10,2))")
    )
    price = "cast(if(p_brand = 'Brand#13', -400, spread) as decimal(10,2))"
    cost = "if(p_brand = 'Brand#14', -0.5BD, spread * 0.55BD)"
    first = _product(
        "'P' || p_partkey",
        "if(p_name = 'red widget', '', '  ' || p_name || ' ')",
        "p_type",
        price,
        cost,
        _ts(FIRST_LOAD),
        "load1",
    )
    resent = f"""case when p_size <= 10 then null when p_size <= 20 then {_ts(OLD_LOAD)}
                 else {_ts(SECOND_LOAD)} end"""
    second = _product(
        "'P' || p_partkey", "p_name", "p_type", f"{price} + 1", cost, resent, "load2"
    )
    support = _product(
        "'S' || s_suppkey",
        "'Support by ' || s_name",
        "'SERVICE'",
        "s_acctbal",
        "0",
        _ts(FIRST_LOAD),
        "load1",
    )
    suppliers = table(spark, sf_dir, "supplier")
    return _rows(parts, first, second).unionAll(_rows(suppliers, support))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lineitem.join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "'O' || l_orderkey as order_id",
        "if(l_discount = 0 and l_tax = 0, null, 'C' || o_custkey) as customer_id",
        "'P' || l_partkey as product_id",
        """case when l_quantity <= 2 then 0 when l_quantity <= 30 then 1 when l_quantity <= 42 then 2
                when l_quantity <= 48 then 3 else 12 end as quantity""",
        "o_orderdate as order_date",
        """case when l_returnflag = 'R' and l_linestatus = 'F' then 'cancelled'
                when l_returnflag = 'N' and l_discount > 0.095 then 'Returned'
                when l_tax > 0.075 then ' Shipped '
                when o_orderstatus = 'F' then 'completed'
                when o_orderstatus = 'O' then 'shipped' else 'pending' end as status""",
        "l_shipdate as _loaded_at",
        "'load1' as _source",
    )


def _rows(df: DataFrame, *versions: str) -> DataFrame:
    """One row per version of each input row, from a single scan."""
    return df.selectExpr(f"inline(array({', '.join(versions)}))")


def _ts(text: str) -> str:
    return f"timestamp_ntz '{text}'"


def _customer(key, first, last, email, country, loaded_at, source) -> str:
    return f"""named_struct('customer_id', {key}, 'first_name', {first}, 'last_name', {last},
        'email', {email}, 'country', {country}, 'created_at', {_ts(SIGN_UP)},
        '_loaded_at', {loaded_at}, '_source', '{source}')"""


def _product(key, name, category, price, cost, loaded_at, source) -> str:
    return f"""named_struct('product_id', {key}, 'product_name', {name}, 'category', {category},
        'price', cast({price} as decimal(10,2)), 'cost', cast({cost} as decimal(10,2)),
        '_loaded_at', {loaded_at}, '_source', '{source}')"""
