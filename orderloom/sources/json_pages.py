"""Paged JSON responses that have been landed as files."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from orderloom.sources.base import SPARK_ERRORS, ExtractionError, Source, reason
from orderloom.sources.json_splits import as_lines
from orderloom.sources.splits import files


def _bytes(text: str) -> int:
    """A size as Spark's settings write it, such as 134217728b, 128MB or 64k."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


class JsonPagesSource(Source):
    """Records from landed response pages: one file per page, or one line per page.

    With ``data_key`` the records are the array under that key; a page without the key has none.
    Without it a page is a list of records or one record. Columns are the union over all pages,
    absent values are null. Give ``record_schema`` to save the pass that infers it.

    A page is read by one task, unless a file is larger than a task's share (``spark.sql.files.maxPartitionBytes``) or
    ``split_pages`` is set: then pages are read in splits, and their records are written as lines in the scratch
    folder first. Elements that are no objects are no records then, and such a page must be UTF-8.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        source_name: str,
        data_key: str | None = None,
        record_schema: StructType | None = None,
        page_per_line: bool = False,
        split_pages: bool | None = None,
    ):
        super().__init__(source_name)
        self.spark = spark
        self.path = str(path)
        self.data_key = data_key
        self.record_schema = record_schema
        self.page_per_line = page_per_line
        self.split_pages = split_pages

    def extract(self, loaded_at: datetime | None = None, verify: bool = False) -> DataFrame:
        """Lazy frame of the records, with metadata. No records give an empty frame.

        With a given ``record_schema`` a broken page fails the job that reads it; with ``verify`` it
        fails here, at the price of one more pass.
        """
        try:
            df = self._records()
            if verify:
                df.write.format("noop").mode("overwrite").save()
        except SPARK_ERRORS as error:
            raise ExtractionError(f"{self.path} cannot be read: {reason(error)}") from error
        return self.add_metadata(df, loaded_at)

    def _is_split(self) -> bool:
        if self.split_pages is not None or self.page_per_line:
            return bool(self.split_pages) and not self.page_per_line
        share = _bytes(self.spark.conf.get("spark.sql.files.maxPartitionBytes"))
        return any(size > share for _, size in files(self.spark, self.path).values())

    def _records(self) -> DataFrame:
        if self._is_split():
            reader = self.spark.read.option("mode", "FAILFAST")
            if self.record_schema is not None:
                reader = reader.schema(self.record_schema)
            return reader.json(as_lines(self.spark, self.path, self.data_key))
        reader = self.spark.read.options(
            multiLine=str(not self.page_per_line).lower(), mode="FAILFAST"
        )
        if self.record_schema is not None:
            page = self.record_schema
            if self.data_key:
                page = StructType().add(self.data_key, ArrayType(self.record_schema))
            reader = reader.schema(page)
        pages = reader.json(self.path)
        if not self.data_key:
            return pages
        if self.data_key not in pages.columns:
            return self.spark.createDataFrame([], StructType())
        records = pages.schema[self.data_key].dataType
        if not isinstance(records, ArrayType):
            raise ExtractionError(f"{self.data_key} is not a list")
        if not isinstance(records.elementType, StructType):
            # Lists that are empty on every page carry no record type.
            empty = pages.where(F.size(F.col(f"`{self.data_key}`")) > 0).isEmpty()
            if not empty:
                raise ExtractionError(f"{self.data_key} holds no records")
            return self.spark.createDataFrame([], StructType())
        return pages.select(F.explode(F.col(f"`{self.data_key}`")).alias("r")).select("r.*")
