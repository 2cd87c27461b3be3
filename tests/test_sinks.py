from __future__ import annotations

import random
import re
import threading
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orderloom.sinks import LoadError, Warehouse
from orderloom.sinks import warehouse as sinks
from orderloom.sinks.versions import Version, VersionLog
from orderloom.sources import DelimitedSource
from tests.conftest import rows

T1 = datetime(2024, 1, 1)


def products(spark, *data):
    schema = "product_id string, product_name string, category string, price string, cost string"
    return spark.createDataFrame(data, schema)


def keys(warehouse, table="products", schema="raw"):
    return [r[0] for r in rows(warehouse.table(table, schema).select("product_id"))]


def tables(warehouse, schema="raw"):
    listed = warehouse.spark.catalog.listTables(f"{warehouse.prefix}{schema}")
    return sorted(t.name for t in listed if not t.isTemporary)


P1, P2 = ("P1", "a", "b", "1.50", "1"), ("P2", "a", "b", "2.50", "1")


def test_create_twice(warehouse):
    warehouse.create()
    assert tables(warehouse) == ["customers", "orders", "products"]


def test_append_by_name_with_defaults(spark, warehouse):
    df = products(spark, P1).select("cost", "price", "category", "product_name", "product_id")
    assert warehouse.load(df, "products") == 1
    assert warehouse.load(products(spark, P2, P2), "products") == 2
    table = warehouse.table("products")
    assert dict(table.dtypes)["price"] == "decimal(10,2)"
    got = rows(table.select("product_id", "price", "_source"))
    assert got == [("P1", Decimal("1.50"), None)] + [("P2", Decimal("2.50"), None)] * 2
    assert table.where("_loaded_at is null").count() == 0


def test_append_refuses_unknown_columns(spark, warehouse):
    with pytest.raises(LoadError, match="extra"):
        warehouse.load(products(spark, P1).selectExpr("*", "1 as extra"), "products")
    assert keys(warehouse) == []


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_append_is_all_or_nothing(spark, warehouse, ansi):
    warehouse.load(products(spark, P1), "products")
    bad = products(spark, *[(f"Q{i}", "a", "b", "1", "1") for i in range(50)],
                   ("QX", "a", "b", "123456789012", "1")).repartition(8)
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(LoadError, match="price can not hold 123456789012"):
            warehouse.load(bad, "products")
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert keys(warehouse) == ["P1"]


def test_append_creates_a_table(spark, warehouse):
    assert warehouse.load(products(spark, P1), "fresh", "staging") == 1
    assert dict(warehouse.table("fresh", "staging").dtypes)["price"] == "string"


def test_replace_takes_the_frames_columns(spark, warehouse):
    warehouse.load(products(spark, P1), "products")
    frame = products(spark, P2).select("product_id", "price")
    assert warehouse.load(frame, "products", if_exists="replace") == 1
    assert warehouse.table("products").dtypes == [("product_id", "string"), ("price", "string")]
    assert tables(warehouse) == ["customers", "orders", "products"]


def test_replace_with_a_frame_that_reads_the_table(spark, warehouse):
    warehouse.load(products(spark, P1, P2), "products")
    part = warehouse.table("products").where("product_id = 'P2'")
    assert warehouse.load(part, "products", if_exists="replace") == 1
    assert keys(warehouse) == ["P2"]


@pytest.mark.parametrize("mode", ["append", "replace", "fail"])
def test_empty_frame_changes_nothing(spark, warehouse, mode):
    warehouse.load(products(spark, P1), "products")
    empty = products(spark, P2).where("false")
    assert warehouse.load(empty, "products", if_exists=mode) == 0
    assert keys(warehouse) == ["P1"]
    assert warehouse.load(empty, "absent", if_exists=mode) == 0
    assert tables(warehouse) == ["customers", "orders", "products"]


def test_fail_mode(spark, warehouse):
    with pytest.raises(LoadError, match="exists"):
        warehouse.load(products(spark, P1), "products", if_exists="fail")
    assert warehouse.load(products(spark, P1), "other", if_exists="fail") == 1
    with pytest.raises(LoadError, match="merge"):
        warehouse.load(products(spark, P1), "other", if_exists="merge")


def test_failed_replace_keeps_the_table(spark, warehouse):
    warehouse.load(products(spark, P1), "products")
    bad = products(spark, P2).selectExpr("product_id", "cast(raise_error('boom') as int) as x")
    with pytest.raises(LoadError, match="boom"):
        warehouse.load(bad, "products", if_exists="replace")
    assert keys(warehouse) == ["P1"]
    assert tables(warehouse) == ["customers", "orders", "products"]


class Died(Exception):
    pass


def dies(*_):
    raise Died


def test_cut_off_swap_is_completed(spark, warehouse, monkeypatch):
    """The job died after the version was made: before the catalog changed, or between its two changes."""
    warehouse.load(products(spark, P1), "products")
    frame = products(spark, P2).select("product_id", "price")
    for step in ("_follow", "_take_name"):
        with monkeypatch.context() as broken:
            broken.setattr(warehouse, step, dies)
            with pytest.raises(Died):
                warehouse.load(frame, "products", if_exists="replace")
        assert keys(warehouse) == ["P2"]
        assert tables(warehouse) == ["customers", "orders", "products"]
        assert warehouse.load(products(spark, P1), "products", if_exists="replace") == 1
    assert keys(Warehouse(spark, warehouse.prefix, warehouse.location)) == ["P1"]


def test_another_writer_sees_versions_that_it_did_not_make(spark, warehouse, monkeypatch):
    other = Warehouse(spark, warehouse.prefix, warehouse.location)
    assert keys(other) == []
    warehouse.load(products(spark, P1), "products", if_exists="replace")
    assert keys(other) == ["P1"]
    monkeypatch.setattr(warehouse, "_take_name", dies)
    with pytest.raises(Died):
        warehouse.load(products(spark, P2).select("product_id"), "products", if_exists="replace")
    assert keys(other) == ["P2"]


def files(df):
    return {f.split("/", 3)[-1] for f in df.inputFiles()}


@pytest.mark.parametrize("partitions", [[], ["product_id"]])
def test_failed_publish_leaves_the_old_version(spark, warehouse, partitions):
    frame = products(spark, P1, P2)
    published = warehouse.publish(frame, "m", "marts", partitions)
    broken = frame.withColumn("price", F.expr("cast(raise_error('boom') as decimal(10,2))"))
    with pytest.raises(Exception, match="boom"):
        warehouse.publish(broken, "m", "marts", partitions)
    assert rows(warehouse.table("m", "marts").select(*frame.columns)) == rows(published) == rows(frame)
    assert tables(warehouse, "marts") == ["m"]


@pytest.mark.parametrize("partitions", [[], ["product_id"]])
def test_a_version_is_a_folder_that_is_never_renamed(spark, warehouse, partitions):
    """The files of a version stay where they were written, and only the current version's are left."""
    frame, seen = products(spark, P1, P2), []
    write = warehouse._new_folder

    def noted(name):
        seen.append(write(name))
        return seen[-1]

    warehouse._new_folder = noted
    for _ in range(3):
        published = warehouse.publish(frame, "m", "marts", partitions)
    assert rows(published) == rows(frame)
    assert all(seen[-1].split("/")[-1] in f for f in published.inputFiles())
    folder = Path(seen[-1].removeprefix("file:")).parent
    assert [f.name for f in folder.iterdir() if f.name != "_versions"] == [seen[-1].split("/")[-1]]


def test_upsert_keeps_partitions_and_rewrites_only_those_it_touches(spark, warehouse):
    table = spark.sql(
        "select id, id % 4 as p, 'old' as v from range(40) union all select 100, cast(null as bigint), 'old'"
    )
    warehouse.publish(table, "t", "marts", ["p"])
    before = files(warehouse.table("t", "marts"))
    changes = spark.sql("select * from values (1L, 1L, 'new'), (5L, 2L, 'moved'), (200L, 7L, 'added') as t(id, p, v)")
    assert warehouse.upsert(changes, "t", "marts", ["id"]) == 3
    after = warehouse.table("t", "marts")
    want = {r.id: (r.p, r.v) for r in table.collect()} | {1: (1, "new"), 5: (2, "moved"), 200: (7, "added")}
    assert {r.id: (r.p, r.v) for r in after.collect()} == want and after.count() == len(want)
    assert [c.name for c in spark.catalog.listColumns(warehouse.name("t", "marts")) if c.isPartition] == ["p"]
    untouched = {f for f in before if re.search(r"/p=(0|3|__HIVE_DEFAULT_PARTITION__)/", f)}
    assert len(untouched) >= 3 and untouched <= files(after)
    assert not {f for f in before - untouched} & files(after)


def test_upsert_empties_a_partition(spark, warehouse):
    warehouse.publish(spark.sql("select id, id as p from range(3)"), "t", "marts", ["p"])
    warehouse.upsert(spark.sql("select 1L as id, 2L as p"), "t", "marts", ["id"])
    assert rows(warehouse.table("t", "marts")) == [(0, 0), (1, 2), (2, 2)]


@pytest.mark.parametrize("step", ["_write_files", "_commit", "_kept_and_gone"])
def test_an_upsert_of_partitions_that_stops_leaves_the_old_table(spark, warehouse, monkeypatch, step):
    """New partitions are complete in a folder that nothing points to; stopping there changes nothing."""
    warehouse.publish(spark.sql("select id, id % 4 as p, 'old' as v from range(40)"), "t", "marts", ["p"])
    before, listed = state_of(warehouse, "t"), files(warehouse.table("t", "marts"))
    changes = spark.sql("select id, id % 4 as p, 'new' as v from range(0, 40, 3)")
    with monkeypatch.context() as broken:
        if step == "_write_files":
            write = sinks._write_files
            broken.setattr(sinks, step, lambda *a: (write(*a), dies()))
        else:
            broken.setattr(warehouse, step, dies)
        with pytest.raises(Died):
            warehouse.upsert(changes, "t", "marts", ["id"])
    assert state_of(warehouse, "t") == before and files(warehouse.table("t", "marts")) == listed
    assert warehouse.upsert(changes, "t", "marts", ["id"]) == 14
    assert state_of(warehouse, "t") == sorted((i, "new" if i % 3 == 0 else "old", i % 4) for i in range(40))


def state_of(warehouse, table):
    return sorted(tuple(r) for r in warehouse.table(table, "marts").select("id", "v", "p").collect())


def test_an_upsert_of_partitions_that_stops_after_its_version_is_completed(spark, warehouse, monkeypatch):
    warehouse.publish(spark.sql("select id, id % 4 as p, 'old' as v from range(8)"), "t", "marts", ["p"])
    with monkeypatch.context() as broken:
        broken.setattr(warehouse, "_add_partitions", dies)
        with pytest.raises(Died):
            warehouse.upsert(spark.sql("select 1L as id, 1L as p, 'new' as v"), "t", "marts", ["id"])
    assert state_of(warehouse, "t") == [(i, "new" if i == 1 else "old", i % 4) for i in range(8)]
    assert warehouse.load(spark.sql("select 9L as id, 7L as p, 'more' as v"), "t", "marts") == 1
    assert warehouse.upsert(spark.sql("select 9L as id, 1L as p, 'moved' as v"), "t", "marts", ["id"]) == 1
    assert state_of(warehouse, "t")[-1] == (9, "moved", 1)


@pytest.mark.parametrize("partitions", [[], ["p"]])
def test_two_upserts_of_one_version(spark, warehouse, monkeypatch, partitions):
    """The second starts from the version that the first replaces: it starts again and no row is lost."""
    warehouse.publish(spark.sql("select id, 'old' as v, id % 3 as p from range(6)"), "t", "marts", partitions)
    other = Warehouse(spark, warehouse.prefix, warehouse.location)
    commit, tried = other._commit, []

    def late(*args):
        if not tried:
            tried.append(warehouse.upsert(spark.sql("select 0L as id, 'first' as v, 0L as p union all select 7L, 'first', 1L"), "t", "marts", ["id"]))
        return commit(*args)

    monkeypatch.setattr(other, "_commit", late)
    changes = spark.sql("select 1L as id, 'second' as v, 1L as p union all select 8L, 'second', 2L")
    assert other.upsert(changes, "t", "marts", ["id"]) == 2
    want = {i: "old" for i in range(6)} | {0: "first", 7: "first", 1: "second", 8: "second"}
    assert {i: v for i, v, _ in state_of(warehouse, "t")} == want == {i: v for i, v, _ in state_of(other, "t")}


def test_an_upsert_that_is_always_late_raises(spark, warehouse, monkeypatch):
    warehouse.publish(spark.sql("select id, 'old' as v, id % 3 as p from range(3)"), "t", "marts")
    monkeypatch.setattr(warehouse, "_commit", lambda *a: (_ for _ in ()).throw(sinks.Conflict("late")))
    with pytest.raises(LoadError, match="other writers"):
        warehouse.upsert(spark.sql("select 1L as id, 'x' as v, 1L as p"), "t", "marts", ["id"])
    assert {v for _, v, _ in state_of(warehouse, "t")} == {"old"}


def test_two_writers_that_create_a_table(spark, warehouse, monkeypatch):
    other = Warehouse(spark, warehouse.prefix, warehouse.location)
    commit = other._commit
    monkeypatch.setattr(other, "_commit", lambda *a: (warehouse.load(products(spark, P1), "new", if_exists="fail"), commit(*a)))
    with pytest.raises(LoadError, match="exists"):
        other.load(products(spark, P2), "new", if_exists="fail")
    assert keys(other, "new") == ["P1"]


def test_an_append_to_a_table_that_is_rebuilt_meanwhile_raises(spark, warehouse, monkeypatch):
    warehouse.load(products(spark, P1), "products", if_exists="replace")
    write = sinks._write

    def late(*args):
        monkeypatch.setattr(sinks, "_write", write)
        Warehouse(spark, warehouse.prefix, warehouse.location).load(products(spark, P2), "products", if_exists="replace")
        return write(*args)

    monkeypatch.setattr(sinks, "_write", late)
    with pytest.raises(LoadError):
        warehouse.load(products(spark, P1), "products")


def test_only_one_marker_of_a_number(spark, tmp_path):
    """Many threads claim the same version: one gets it."""
    log, won = VersionLog(spark, f"file:{tmp_path}/t"), []

    def claim(i):
        try:
            log.claim(Version(1, f"folder {i}", "a int"))
            won.append(i)
        except sinks.Conflict:
            pass

    threads = [threading.Thread(target=claim, args=(i,)) for i in range(12)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert len(won) == 1 and log.latest() == Version(1, f"folder {won[0]}", "a int")
    log.claim(Version(2, "f", "a int", ["a"], ["x"]))
    assert log.number() == 2 and log.latest().kept == ["x"]


def test_publish_and_views(spark, warehouse):
    frame = products(spark, P1, P2)
    assert warehouse.publish(frame, "m", "marts").count() == 2
    assert warehouse.publish(frame.where("false"), "m", "marts").count() == 0
    split = warehouse.publish(frame, "p", "marts", partition_by=["product_id"])
    assert split.columns == frame.columns and rows(split) == rows(frame)
    again = warehouse.publish(frame.where("product_id = 'P1'"), "p", "marts", ["product_id"])
    assert [r.product_id for r in again.collect()] == ["P1"]
    view = warehouse.publish_view(frame, f"{warehouse.prefix}v")
    assert rows(view) == rows(frame)


def test_drop(spark, warehouse):
    warehouse.publish(products(spark, P1), "m", "marts")
    spark.sql(f"DROP TABLE {warehouse.name('m', 'marts')}")
    assert keys(warehouse, "m", "marts") == ["P1"]
    warehouse.drop("m", "marts")
    assert tables(warehouse, "marts") == []
    assert warehouse.load(products(spark, P2), "m", "marts", if_exists="fail") == 1
    assert keys(warehouse, "m", "marts") == ["P2"]


def test_query(spark, warehouse):
    warehouse.load(products(spark, P1, P2), "products")
    name = warehouse.name("products", "raw")
    got = warehouse.execute_query(f"select sum(price) as s from {name}").first()
    assert got["s"] == Decimal("4.00")


# Upsert ------------------------------------------------------------------------------------------

SCHEMA = "k1 int, k2 string, a int, b string, c string, ord int"


def state(warehouse):
    return rows(warehouse.table("t"))


def fill(spark, warehouse, data):
    warehouse.load(spark.createDataFrame(data, SCHEMA), "t")


def change(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def test_upsert_updates_and_inserts(spark, warehouse):
    fill(spark, warehouse, [(1, "x", 1, "b1", "c1", 0), (2, "x", 2, "b2", "c2", 0)])
    df = change(spark, [(1, "x", 10, "B", "C", 1), (3, "x", 30, "B", None, 1)])
    assert warehouse.upsert(df, "t", "raw", ["k1", "k2"], order_by=["ord"]) == 2
    assert state(warehouse) == sorted(
        [(1, "x", 10, "B", "C", 1), (2, "x", 2, "b2", "c2", 0), (3, "x", 30, "B", None, 1)],
        key=repr,
    )
    assert tables(warehouse) == ["customers", "orders", "products", "t"]


def test_upsert_of_some_columns_with_repeated_keys(spark, warehouse):
    fill(spark, warehouse, [(1, "x", 1, "b1", "c1", 0)])
    df = change(spark, [(1, "x", 5, "n1", "m1", 2), (1, "x", 4, "n0", "m0", 1),
                        (9, "x", 8, "n3", "m3", 4), (9, "x", 7, "n2", "m2", 3)])
    assert warehouse.upsert(df, "t", "raw", ["k1", "k2"], ["a"], ["ord"]) == 4
    # A known key keeps its other columns, a new key has them from its first change.
    assert state(warehouse) == [(1, "x", 5, "b1", "c1", 0), (9, "x", 8, "n2", "m2", 3)]


def test_upsert_of_null_keys_always_inserts(spark, warehouse):
    fill(spark, warehouse, [(None, "x", 1, "b", "c", 0)])
    df = change(spark, [(None, "x", 2, "b", "c", 1), (None, "x", 2, "b", "c", 1)])
    assert warehouse.upsert(df, "t", "raw", ["k1", "k2"], order_by=["ord"]) == 2
    assert state(warehouse) == sorted(
        [(None, "x", 1, "b", "c", 0), *[(None, "x", 2, "b", "c", 1)] * 2], key=repr
    )


def test_upsert_with_absent_columns(spark, warehouse):
    warehouse.load(products(spark, P1), "products")
    before = warehouse.table("products").first()
    df = spark.createDataFrame([("P1", "9.99"), ("P7", "7.77")], "product_id string, price string")
    assert warehouse.upsert(df, "products", "raw", ["product_id"]) == 2
    got = {r.product_id: r for r in warehouse.table("products").collect()}
    assert got["P1"].price == Decimal("9.99") and got["P1"]._loaded_at == before._loaded_at
    assert got["P1"].category == "b"
    assert got["P7"].category is None and got["P7"]._loaded_at is not None


def test_upsert_without_update_columns_only_inserts(spark, warehouse):
    fill(spark, warehouse, [(1, "x", 1, "b1", "c1", 0)])
    df = change(spark, [(1, "x", 5, "n", "n", 1), (2, "x", 6, "n", "n", 1)])
    assert warehouse.upsert(df, "t", "raw", ["k1", "k2"], [], ["ord"]) == 2
    assert state(warehouse) == [(1, "x", 1, "b1", "c1", 0), (2, "x", 6, "n", "n", 1)]
    assert warehouse.upsert(df, "t", "raw", ["k1", "k2"], [], ["ord"]) == 2
    assert len(state(warehouse)) == 2


def test_upsert_of_nothing(spark, warehouse):
    fill(spark, warehouse, [(1, "x", 1, "b1", "c1", 0)])
    assert warehouse.upsert(change(spark, []), "t", "raw", ["k1", "k2"]) == 0
    assert len(state(warehouse)) == 1


def test_upsert_refuses_duplicate_target_keys(spark, warehouse):
    fill(spark, warehouse, [(1, "x", 1, "b1", "c1", 0)] * 2)
    with pytest.raises(LoadError, match="not unique"):
        warehouse.upsert(change(spark, [(1, "x", 2, "b", "c", 1)]), "t", "raw", ["k1", "k2"])
    assert len(state(warehouse)) == 2
    assert tables(warehouse) == ["customers", "orders", "products", "t"]


def test_upsert_refuses_unknown_columns(spark, warehouse):
    fill(spark, warehouse, [(1, "x", 1, "b1", "c1", 0)])
    with pytest.raises(LoadError, match="zz"):
        warehouse.upsert(change(spark, [(1, 2)], "k1 int, zz int"), "t", "raw", ["k1"])


def test_upsert_takes_the_last_line_of_a_file(spark, warehouse, tmp_path, monkeypatch):
    """Without order columns the position in the file decides, over splits and files; it is not stored."""
    folder = tmp_path / "changes"
    folder.mkdir()
    lines = [f"{i % 37},x,{i},b{i},c{i},{(i * 7919) % 1000}" for i in range(900)]
    for part in range(3):
        body = "\n".join(["k1,k2,a,b,c,ord", *lines[300 * part : 300 * part + 300]])
        (folder / f"part-{part}.csv").write_text(body + "\n")
    fill(spark, warehouse, [(1, "x", 0, "old", "old", 0)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        source = DelimitedSource(spark, str(folder), number_rows=True)
        df = source.extract().drop("_loaded_at", "_source")
        assert df.rdd.getNumPartitions() > 4
        assert warehouse.upsert(df, "t", "raw", ["k1", "k2"], ["a", "b"]) == 900
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "_row" not in warehouse.table("t").columns
    got = {r.k1: (r.a, r.b, r.c) for r in warehouse.table("t").collect()}
    last = {i % 37: i for i in range(900)}
    first = {k: k for k in range(37)}
    assert got == {k: (last[k], f"b{last[k]}", "old" if k == 1 else f"c{first[k]}") for k in range(37)}


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_upsert_against_brute_force(spark, warehouse, broadcast):
    generator = random.Random(11)

    def change_row(i):
        key = generator.choice([None, *range(30)])
        return (key, generator.choice(["x", "y"]), i, f"b{i}", generator.choice([None, "c"]), i)

    start = [(k, "x", k, "b", "c", 0) for k in range(20)]
    changes = [change_row(i) for i in range(1, 300)]
    table = {row[:2]: list(row) for row in start}
    loose = []
    for row in changes:
        if row[0] is None:
            loose.append(row)
        elif row[:2] in table:
            table[row[:2]][2] = row[2]
            table[row[:2]][4] = row[4]
        else:
            table[row[:2]] = list(row)
    expected = sorted([*map(tuple, table.values()), *loose], key=repr)

    fill(spark, warehouse, start)
    generator.shuffle(changes)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = change(spark, changes).repartition(5)
        assert warehouse.upsert(df, "t", "raw", ["k1", "k2"], ["a", "c"], ["ord"]) == 299
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert state(warehouse) == expected
