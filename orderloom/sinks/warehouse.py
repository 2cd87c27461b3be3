"""Tables of the four layers and the ways to fill them."""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from orderloom.operators.upsert import KIND, LOOSE, MET, NEW, found_keys, inserted, merge_rows, reduce_changes
from orderloom.session import materialize, remove_folder
from orderloom.sinks.versions import Conflict, Version, VersionLog
from orderloom.sources.base import ROW, SPARK_ERRORS, reason

logger = logging.getLogger(__name__)

LAYERS = ("raw", "staging", "intermediate", "marts")
MODES = ("append", "replace", "fail")

# Names of a new version until it takes the table's name, the folders of versions, and the property with its number.
_NEXT = "__next_"
_VERSION = re.compile(r"/v-[0-9a-f]{32}(?=/|$)")
_NUMBER = "orderloom.version"
#: How often a writer starts again after another one was first.
ATTEMPTS = 5
#: Partitions that one statement adds to a new catalog entry.
_PARTITIONS_AT_ONCE = 500

# Columns of the raw tables.
_LOAD_COLUMNS = "_loaded_at timestamp_ntz, _source string"
RAW_TABLES = {
    "customers": "customer_id string, first_name string, last_name string, email string, "
    f"country string, created_at timestamp_ntz, {_LOAD_COLUMNS}",
    "products": "product_id string, product_name string, category string, "
    f"price decimal(10,2), cost decimal(10,2), {_LOAD_COLUMNS}",
    "orders": "order_id string, customer_id string, product_id string, quantity int, "
    f"order_date timestamp_ntz, status string, {_LOAD_COLUMNS}",
}


class LoadError(Exception):
    """A table could not be loaded; it is as it was before."""


class Warehouse:
    """Parquet tables in one database per layer.

    ``prefix`` names the databases (``<prefix>raw`` and so on), ``location`` is the folder they
    live in; by default that is Spark's warehouse folder.

    Every version of a table is a folder of its own, written whole before anything points to it. One marker
    file makes it the table's version (see ``versions``); then the catalog follows, and the folders that no
    version needs are deleted last. No file is ever renamed or overwritten by a rebuild, so a job that fails leaves the old
    version as it was.

    Writers may work at the same time. A rebuild that comes later replaces the earlier one; an upsert that started
    from a version that is not the latest any more starts again, ``ATTEMPTS`` times at most; of two that
    create a table with ``fail`` one is refused. An append whose table is rebuilt meanwhile raises ``LoadError``, as
    the other writer may or may not have seen its rows.
    """

    def __init__(self, spark: SparkSession, prefix: str = "", location: str | None = None):
        self.spark = spark
        self.prefix = prefix
        self.location = location
        self._followed: dict[str, int] = {}

    def create(self) -> Warehouse:
        """Create databases and raw tables that do not exist yet."""
        for layer in LAYERS:
            place = f" LOCATION '{self.location}/{layer}'" if self.location else ""
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.prefix}{layer}{place}")
        for table, columns in RAW_TABLES.items():
            name = self.name(table, "raw")
            if not self._finished(name):
                place = self._new_folder(name)
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{place}'")
        return self

    def name(self, table: str, schema: str) -> str:
        return f"{self.prefix}{schema}.{table}"

    def table(self, table: str, schema: str = "raw") -> DataFrame:
        """Scan of a table."""
        name = self.name(table, schema)
        self._finished(name)
        return self.spark.table(name)

    def drop(self, table: str, schema: str) -> None:
        """Remove a table with all its versions.

        (One that SQL alone drops comes back at the next access here: its files and its latest version's marker are there.)
        """
        name = self.name(table, schema)
        remove_folder(self.spark, self._table_folder(name))
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._followed.pop(name, None)

    def execute_query(self, query: str) -> DataFrame:
        """Result of an SQL query over the tables."""
        return self.spark.sql(query)

    def load(
        self, df: DataFrame, table_name: str, schema: str = "raw", if_exists: str = "append"
    ) -> int:
        """Write a frame to a table and return the number of rows written.

        ``append`` matches columns by name: unknown ones are refused, absent ones are filled with
        the table's default or null. ``replace`` gives the table the frame's own columns. ``fail``
        refuses a table that exists. An empty frame changes nothing. Rows are counted while they
        are written, so the frame is evaluated once.
        """
        name = self.name(table_name, schema)
        if if_exists not in MODES:
            raise LoadError(f"if_exists must be one of {MODES}, not {if_exists}")
        try:
            exists = self._finished(name)
            if exists and if_exists == "fail":
                if not df.isEmpty():
                    raise LoadError(f"{name} exists already")
                rows = 0
            elif exists and if_exists == "append":
                rows = self._append(df, name)
            else:
                rows = self._rebuild(df.drop(ROW), name, is_new=if_exists == "fail")
        except Conflict as error:
            raise LoadError(f"{name} exists already") from error
        except SPARK_ERRORS as error:
            raise LoadError(f"{name} was not loaded: {reason(error)}") from error
        if rows == 0:
            logger.warning("Empty frame, nothing loaded to %s", name)
        else:
            logger.info("Loaded %d rows to %s", rows, name)
        return rows

    def publish(
        self, df: DataFrame, table: str, schema: str, partition_by: Sequence[str] = ()
    ) -> DataFrame:
        """Rebuild a model's table, empty or not, and return its scan.

        The old table serves readers until the new one is complete. With ``partition_by`` rows are
        brought together by partition before the write; the rebalance hint lets Spark split large
        partitions and merge small ones into files of even size.
        """
        name = self.name(table, schema)
        self._finished(name)
        rows = df.hint("rebalance", *partition_by) if partition_by else df
        self._rebuild(rows, name, keep_empty=True, partition_by=partition_by)
        return self.spark.table(name).select(*df.columns)

    def publish_view(self, df: DataFrame, name: str) -> DataFrame:
        """Register a model under a session-wide name without computing it."""
        df.createOrReplaceTempView(name)
        return self.spark.table(name)

    def upsert(
        self,
        df: DataFrame,
        table_name: str,
        schema: str,
        key_columns: Sequence[str],
        update_columns: Sequence[str] | None = None,
        order_by: Sequence[str] | None = None,
    ) -> int:
        """Insert rows or update those whose key exists; return the number of input rows.

        ``order_by`` names the columns that say which of several changes of one key comes later. By default
        that is ``_row``, the row's number in its source, if the frame has it, and otherwise all columns are compared: a
        distributed frame has no row order of its own. The table must be unique by key where it meets the changes.

        The table keeps its partitioning. A partitioned table gets new files only for the partitions that the
        changes touch; any other is written anew beside the old version, which serves until then. Either way
        all changes are seen at once or not at all.
        """
        name = self.name(table_name, schema)
        try:
            self._finished(name)
            changes = self._conform(df, name, fill=False)
            columns = [c for c in changes.columns if c != ROW]
            updates = [c for c in columns if c not in key_columns] if update_columns is None else list(update_columns)
            order = order_by or ([ROW] if ROW in changes.columns else columns)
            # Reduced before anything else: what is written, joined and compared has one row for each key.
            counts = Observation()
            reduced = reduce_changes(changes, columns, key_columns, updates, order).observe(
                counts, F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col(LOOSE).isNull()).alias("keys")
            )
            merge = _Merge(materialize(reduced, "changes"), columns, list(key_columns), updates, counts.get["keys"])
            if counts.get["rows"]:
                self._merge(name, merge)
            return counts.get["rows"]
        except SPARK_ERRORS as error:
            raise LoadError(f"{name} was not loaded: {reason(error)}") from error

    def _merge(self, name: str, merge: _Merge) -> None:
        """Merge the changes into the latest version, again if another writer was first."""
        for _ in range(ATTEMPTS):
            base = self._log(name).number()
            try:
                self._merge_into(name, base, merge)
                return
            except Conflict:
                logger.info("%s was changed by another writer, starting again", name)
            except SPARK_ERRORS:
                # The other writer may have deleted files of the version that was being read.
                if self._log(name).number() == base:
                    raise
            self._finished(name)
            self.spark.catalog.refreshTable(name)
        raise LoadError(f"{name} was changed by other writers {ATTEMPTS} times")

    def _merge_into(self, name: str, base: int, merge: _Merge) -> None:
        target, parts = self.spark.table(name), self._partition_columns(name)
        if not merge.updates and merge.all_known(target):
            return
        touched = materialize(merge.touched(target, parts), "touched") if parts else None
        merged = merge.rows(_of_partitions(target, touched, parts) if parts else target)
        counts = Observation()
        counted = merged.observe(
            counts, F.count_if(F.col(KIND) == MET).alias("met"), F.count_if(F.col(KIND) == NEW).alias("new")
        )
        folder = self._new_folder(name)
        try:
            _write_files(counted.drop(KIND), folder, parts)
            if counts.get["met"] > merge.n_keys - counts.get["new"]:
                raise LoadError(f"{name} is not unique by {merge.keys}")
            kept, gone = self._kept_and_gone(target, touched, parts) if parts else ([], [])
            self._commit(name, Version(base + 1, folder, _ddl(target), parts, kept), gone)
        except BaseException:
            self._remove_unused(name, folder)
            raise

    def _conform(self, df: DataFrame, name: str, fill: bool) -> DataFrame:
        """The frame with the table's types; with ``fill`` also with all its columns, in order."""
        schema = self.spark.table(name).schema
        unknown = [c for c in df.columns if c not in schema.names and c != ROW]
        if unknown:
            raise LoadError(f"{name} has no column {unknown}")
        defaults = _defaults()

        def value(column: str) -> Column:
            kind = schema[column].dataType
            if column not in df.columns:
                return defaults.get(column, F.lit(None)).cast(kind)
            given = F.col(f"`{column}`")
            return given if df.schema[column].dataType == kind else _exactly(given, column, kind)

        names = schema.names if fill else [c for c in df.columns if c in schema.names]
        number = [] if fill or ROW not in df.columns or ROW in schema.names else [F.col(ROW)]
        return df.select(*(value(c).alias(c) for c in names), *number)

    def _append(self, df: DataFrame, name: str) -> int:
        """Spark commits an append as one job; the version stays."""
        base = self._log(name).number()
        rows = _write(self._conform(df, name, fill=True), name)
        if self._log(name).number() != base:
            raise LoadError(f"{name} was rebuilt while rows were appended; whether it has them is not known")
        return rows

    def _rebuild(
        self,
        df: DataFrame,
        name: str,
        keep_empty: bool = False,
        partition_by: Sequence[str] = (),
        is_new: bool = False,
    ) -> int:
        """Write a new version; with ``is_new`` it has to be the first one."""
        folder = self._new_folder(name)
        try:
            rows = _write_files(df, folder, partition_by)
            if not rows and not keep_empty:
                remove_folder(self.spark, folder)
                return 0
            while True:
                number = 1 if is_new else self._log(name).number() + 1
                try:
                    self._commit(name, Version(number, folder, _ddl(df), list(partition_by)))
                    return rows
                except Conflict:
                    if is_new:
                        raise
        except BaseException:
            self._remove_unused(name, folder)
            raise

    def _remove_unused(self, name: str, folder: str) -> None:
        """Remove the folder of a version that did not come about."""
        latest = self._log(name).latest()
        if latest is None or latest.folder != folder:
            remove_folder(self.spark, folder)

    def _commit(self, name: str, version: Version, gone: Sequence[str] = ()) -> None:
        """Make the version the table's, let the catalog follow, and delete what no version needs any more: whole
        folders of versions, and partitions that are gone from the others."""
        log = self._log(name)
        before = log.latest()
        place = self._location(name)
        log.claim(version)
        self._follow(name, version)
        old = {version_root(f) for f in [*((before.folder, *before.kept) if before else ()), *([place] if place else ())]}
        needed = {version_root(f) for f in (version.folder, *version.kept)}
        for folder in [*(old - needed - {None}), *(f for f in gone if version_root(f) in needed)]:
            remove_folder(self.spark, folder)

    def _follow(self, name: str, version: Version) -> None:
        """Let the catalog point to a version.

        Where columns and layout stay, that is a change of the table's location. Otherwise a new entry takes the name of the
        old one, which is dropped without its files; if the job dies between these two, ``_finished``
        starts again from the version's marker.
        """
        number = f"'{_NUMBER}' = '{version.number}'"
        exists = self.spark.catalog.tableExists(name)
        if exists and not version.partition_by and _ddl(self.spark.table(name)) == version.columns and not self._partition_columns(name):
            self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{version.folder}'")
            self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({number})")
        else:
            fresh = f"{name}{_NEXT}{version.number}"
            self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")
            by = ", ".join(f"`{c}`" for c in version.partition_by)
            self.spark.sql(
                f"CREATE TABLE {fresh} ({version.columns}) USING parquet {f'PARTITIONED BY ({by})' if by else ''} "
                f"LOCATION '{version.folder}' TBLPROPERTIES ({number})"
            )
            if by:
                self.spark.sql(f"ALTER TABLE {fresh} RECOVER PARTITIONS")
                self._add_partitions(fresh, version.kept, len(version.partition_by))
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._take_name(fresh, name)
        self.spark.catalog.refreshTable(name)
        self._followed[name] = version.number

    def _add_partitions(self, name: str, folders: Sequence[str], depth: int) -> None:
        """Partitions whose files lie in folders of earlier versions."""
        for start in range(0, len(folders), _PARTITIONS_AT_ONCE):
            added = []
            for folder in folders[start : start + _PARTITIONS_AT_ONCE]:
                pairs = (part.split("=", 1) for part in folder.rstrip("/").split("/")[-depth:])
                spec = ", ".join(f"`{unquote(c)}` = {_literal(_partition_value(v))}" for c, v in pairs)
                added.append(f"PARTITION ({spec}) LOCATION '{folder}'")
            self.spark.sql(f"ALTER TABLE {name} ADD {' '.join(added)}")

    def _take_name(self, fresh: str, name: str) -> None:
        """Only the catalog changes: the table is external, so its files stay where they are."""
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")

    def _finished(self, name: str) -> bool:
        """Whether the table exists, after the catalog has followed a version that it has not followed yet."""
        database, table = name.split(".")
        if not self.spark.catalog.databaseExists(database):
            return False
        exists, number = self.spark.catalog.tableExists(name), self._log(name).number()
        if number and (not exists or self._followed.get(name) != number):
            if not exists or self._number_of(name) != number:
                self._follow(name, self._log(name).latest())
                for left in self.spark.sql(f"SHOW TABLES IN {database} LIKE '{table}{_NEXT}*'").collect():
                    if int(left["tableName"].rsplit("_", 1)[1]) <= number:
                        self.spark.sql(f"DROP TABLE IF EXISTS {database}.{left['tableName']}")
            self._followed[name], exists = number, True
        return exists

    def _number_of(self, name: str) -> int:
        """The version that the catalog points to."""
        found = self.spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key") == _NUMBER).first()
        return int(found["value"]) if found else 0

    def _log(self, name: str) -> VersionLog:
        return VersionLog(self.spark, self._table_folder(name))

    def _table_folder(self, name: str) -> str:
        database, table = name.split(".")
        root = self.spark.catalog.getDatabase(database).locationUri
        return f"{root.rstrip('/')}/{table}"

    def _new_folder(self, name: str) -> str:
        return f"{self._table_folder(name)}/v-{uuid.uuid4().hex}"

    def _location(self, name: str) -> str | None:
        if not self.spark.catalog.tableExists(name):
            return None
        lines = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
        return next(line["data_type"] for line in lines if line["col_name"] == "Location")

    def _partition_columns(self, name: str) -> list[str]:
        return [c.name for c in self.spark.catalog.listColumns(name) if c.isPartition]

    def _kept_and_gone(self, target: DataFrame, touched: DataFrame, parts: list[str]) -> tuple[list[str], list[str]]:
        """Folders of the partitions that stay as they are, and of those that are replaced."""
        folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
        folders = target.select(*(F.col(f"`{c}`") for c in parts), folder.alias("_folder")).distinct()
        marked = touched.withColumn("_touched", F.lit(True))
        found = folders.join(F.broadcast(marked), _same(folders, marked, parts), "left").select("_folder", "_touched").collect()
        return [r[0] for r in found if not r[1]], [r[0] for r in found if r[1]]


@dataclass(frozen=True)
class _Merge:
    """Reduced changes, a written table, and what to do with them."""

    reduced: DataFrame
    columns: list[str]
    keys: list[str]
    updates: list[str]
    n_keys: int

    def rows(self, target: DataFrame) -> DataFrame:
        return merge_rows(target, self.reduced, self.columns, self.keys, self.updates, _defaults())

    def all_known(self, target: DataFrame) -> bool:
        return self.reduced.join(found_keys(target, self.reduced, self.keys), self.keys, "left_anti").isEmpty()

    def touched(self, target: DataFrame, parts: Sequence[str]) -> DataFrame:
        """Partitions that hold a row to update or may get a new one."""
        names = [F.col(f"`{c}`") for c in parts]
        held = target.join(self.reduced.select(*self.keys), self.keys, "left_semi").select(*names)
        to = [inserted(c, target, self.columns, self.keys, self.updates, _defaults()) for c in parts]
        return held.unionAll(self.reduced.select(*to)).distinct()


def version_root(folder: str) -> str | None:
    """The version's folder that a folder is or lies in."""
    found = _VERSION.search(folder)
    return folder[: found.end()] if found else None


def _same(one: DataFrame, two: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (one[f"`{c}`"].eqNullSafe(two[f"`{c}`"]) for c in columns))


def _of_partitions(df: DataFrame, touched: DataFrame, parts: list[str]) -> DataFrame:
    """Rows of the given partitions.

    Each column's values are a list that prunes the scan, which does not grow with combinations; a join finds those.
    """

    def one_of(column: str) -> Column:
        given = F.col(f"`{column}`")
        values = [r[0] for r in touched.select(f"`{column}`").distinct().collect()]
        found = given.isin(*(v for v in values if v is not None))
        return found | given.isNull() if None in values else found

    coarse = df.where(reduce(lambda a, b: a & b, (one_of(c) for c in parts)))
    return coarse if len(parts) == 1 else coarse.join(touched, _same(coarse, touched, parts), "left_semi")


def _partition_value(text: str) -> str | None:
    # Fixed value: the folder name of null.
    return None if text == "__HIVE_DEFAULT_PARTITION__" else unquote(text)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _literal(value: object) -> str:
    if value is None:
        return "null"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _exactly(given: Column, name: str, kind: DataType) -> Column:
    """Cast that fails the load for a value the type can not hold, whatever the session's mode."""
    value = given.try_cast(kind)
    problem = F.concat(F.lit(f"{name} can not hold "), given.cast("string"))
    lost = given.isNotNull() & value.isNull()
    return F.when(lost, F.raise_error(problem).cast(kind)).otherwise(value)


def _defaults() -> dict:
    """Values for absent columns, taken at load time."""
    return {"_loaded_at": F.localtimestamp()}


def _write(df: DataFrame, name: str) -> int:
    """Append rows that have the table's columns in its order, and count them on the way."""
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.insertInto(name)
    return written.get["rows"]


def _write_files(df: DataFrame, folder: str, partition_by: Sequence[str] = ()) -> int:
    """Write to a folder that nothing points to yet and count the rows on the way."""
    written = Observation()
    frame = df.observe(written, F.count(F.lit(1)).alias("rows"))
    frame.write.partitionBy(*partition_by).parquet(folder)
    return written.get["rows"]
