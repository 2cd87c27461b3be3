"""Delimited text files with a header line."""

from __future__ import annotations

import codecs
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from operator import or_
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.sources import splits
from orderloom.sources.base import ROW, SPARK_ERRORS, ExtractionError, Source, reason

# Texts that mean "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_LONGEST_TOKEN = max(len(token.encode()) for token in NULL_TOKENS)

# Dates other than ISO that are read by default; numbers alone follow one of two orders.
DATE_FORMATS = (
    "yyyy/M/d[ H:mm[:ss]]",
    "yyyyMMdd",
    "MMM d[,] yyyy",
    "MMMM d[,] yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
)
MONTH_FIRST = ("M/d/yyyy[ H:mm[:ss]]", "M.d.yyyy[ H:mm[:ss]]", "M-d-yyyy[ H:mm[:ss]]")
DAY_FIRST = ("d/M/yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]")
# An offset ends the text, save for a line break, so its sign or letter is one of the last eight characters.
_OFFSET_MARKS = ("+", "-", "Z", "C")
_WITH_OFFSET = r"\d[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)? ?(Z|UTC|[+-]\d{1,2}(:?\d{2})?)$"

# Not expected in any file: the first stands for "no null token", the second ends a re-parsed line.
_NO_TOKEN = "\u0001"
_END_MARK = "\u0002"
_RAW_LINE = "_raw_line"

UNPARSED = "_unparsed_"
#: How the error for a line break inside quotes begins, where none is expected.
BROKEN_RECORD = "Line break inside quotes, read with multi_line"


class DelimitedSource(Source):
    """One delimited file, or a folder or glob of files that share one header line.

    All columns are read as text; values get their types at validation, from the record schema.
    Columns in ``parse_dates`` become timestamps. Text that is not a date leaves a null there and
    stays in the helper column ``_unparsed_<name>``, so that validation can reject the row. ISO dates
    are read first, then ``date_formats`` in their order: a list for all columns, or a dict of
    lists by column; by default ``DATE_FORMATS`` and dates of three numbers with slashes, dots or dashes.
    Their order is month, day, year, or with ``day_first`` day, month, year; it is the same for
    every row and never guessed. A moment with an offset is converted to UTC.

    ``infer_types`` picks bigint, double or boolean for columns whose values all fit. It costs one
    pass over the data.

    Line breaks inside quotes are accepted. By default a pass over the quotes of all lines looks for them; with
    ``multi_line`` they are expected, and without (False) the pass is saved and such a break fails the
    read. Large files are read in splits either way (character sets of two or four bytes are not). Where breaks
    are expected or found, a quote that is never closed fails in ``extract``.

    ``number_rows`` adds ``_row``, the number of each row from 0 over all files in the order of their paths.
    It costs one pass that parses nothing (none where line breaks are expected).
    """

    def __init__(
        self,
        spark: SparkSession,
        file_path: str,
        source_name: str | None = None,
        delimiter: str = ",",
        encoding: str = "utf-8",
        parse_dates: Sequence[str] = (),
        multi_line: bool | None = None,
        infer_types: bool = False,
        date_formats: Sequence[str] | Mapping[str, Sequence[str]] | None = None,
        day_first: bool = False,
        number_rows: bool = False,
    ):
        self.spark = spark
        self.file_path = str(file_path)
        super().__init__(source_name or PurePosixPath(self.file_path).stem)
        self.parse_dates = tuple(parse_dates or ())
        self.multi_line = multi_line
        self.infer_types = infer_types
        self.number_rows = number_rows
        self._charset = _charset(encoding)
        self.date_formats = (*DATE_FORMATS, *(DAY_FIRST if day_first else MONTH_FIRST)) if date_formats is None else date_formats
        self._line_options = {
            "sep": delimiter,
            "quote": '"',
            "escape": '"',
            "nullValue": _NO_TOKEN,
            "emptyValue": "",
            "mode": "PERMISSIVE",
        }
        self._file_options = {
            **self._line_options,
            "header": "true",
            "encoding": self._charset,
        }
        self._quoted_records = splits.QuotedRecords(spark, self.file_path, delimiter, self._charset)

    def extract(self, loaded_at: datetime | None = None, verify: bool = False) -> DataFrame:
        """Lazy frame of the records, with metadata.

        A missing or empty file, an unknown encoding and a missing date column fail here. A row
        with too many fields, or cut off inside quotes, fails the job that reads it, so nothing of
        the file is loaded; with ``verify`` it fails here, at the price of one more pass.
        """
        try:
            df = self._typed(self._text_columns())
            if verify:
                df.write.format("noop").mode("overwrite").save()
        except SPARK_ERRORS as error:
            raise ExtractionError(f"{self.file_path} cannot be read: {reason(error)}") from error
        return self.add_metadata(df, loaded_at)

    def _header(self) -> list[str]:
        """Fields of the header line; blank ones are null."""
        # Reading whole files is lazy too: only the beginning of one is read.
        lines = self.spark.read.options(**self._file_options).option("header", "false")
        rows = lines.option("multiLine", str(self.multi_line is not False).lower()).csv(self.file_path)
        if not rows.columns:
            raise ExtractionError(f"{self.file_path} has no columns")
        return list(rows.first())

    def _text_columns(self) -> DataFrame:
        header = self._header()
        names = _column_names(header)
        absent = sorted(set(self.parse_dates) - set(names))
        if absent:
            raise ExtractionError(f"{self.file_path} has no column {absent} to parse as date")
        fields = ", ".join(f"{_quoted(n)} string" for n in names)
        if not splits.can_split(self._charset):
            return self._fitting(self._scan(names, header, fields, True), names, fields, True)
        multi_line = self.multi_line
        # With one column, a line that was cut off could not be told from a whole one afterwards.
        if multi_line is None or not multi_line and len(names) == 1:
            multi_line = not self._quoted_records.none_broken()
        if multi_line:
            return self._fitting(self._parsed_records(names, header, fields), names, fields, True)
        return self._fitting(self._scan(names, header, fields, False), names, fields, False)

    def _scan(self, names: list[str], header: list, fields: str, multi_line: bool) -> DataFrame:
        """The rows as Spark's reader gives them; whole files at a time where records may span lines."""
        df = (
            self.spark.read.options(**self._file_options)
            .option("multiLine", str(multi_line).lower())
            # Every file's header line has to be like the first one's. Blank and repeated names
            # can not be compared, so with these the columns are bound by position.
            .option("enforceSchema", str(names != header).lower())
            .option("columnNameOfCorruptRecord", _RAW_LINE)
            .schema(f"{fields}, `{_RAW_LINE}` string")
            .csv(self.file_path)
        )
        if not self.number_rows:
            return df
        located = df.select("*", *(c.alias(n) for n, c in splits.placed(df).items()))
        return splits.numbered(self.spark, self.file_path, located, ROW)

    def _parsed_records(self, names: list[str], header: list, fields: str) -> DataFrame:
        """The rows of records that may span lines, whose files are read in splits."""
        records = self._quoted_records.frame()
        options = {**self._line_options, "multiLine": "true", "columnNameOfCorruptRecord": _RAW_LINE}
        parsed = F.from_csv("record", F.lit(f"{fields}, `{_RAW_LINE}` string"), options)
        # An exploded array keeps the record from being parsed once per column.
        rows = records.select("header", F.col("row").alias(ROW), F.explode(F.array(parsed)).alias("r"))
        same = F.lit(True)
        for name in names if names == header else []:
            same = same & F.col("r")[name].eqNullSafe(F.lit(name))
        other = F.raise_error(F.lit(f"A file of {self.file_path} has another header")).cast("boolean")
        # One condition: as two, the second would imply the first, and Spark would leave that out.
        is_row = F.when(~F.col("header"), True).when(same, False).otherwise(other)
        return rows.where(is_row).select("r.*", *([ROW] if self.number_rows else []))

    def _fitting(self, df: DataFrame, names: list[str], fields: str, multi_line: bool) -> DataFrame:
        """The named columns of rows that are neither too long nor cut off; others fail the read."""
        # The second condition is always true. It is not deterministic, which keeps Spark from
        # merging later filters into this one: they might drop a row before it is found broken.
        fits = self._row_fits(names, fields, multi_line) & (F.monotonically_increasing_id() >= 0)
        return df.where(fits).select(*(_null_tokens(n) for n in names), *([ROW] if self.number_rows else []))

    def _row_fits(self, names: list[str], fields: str, multi_line: bool) -> Column:
        """True, or an error for a row with more fields than the header or cut off inside quotes.

        Spark keeps the raw line of rows whose field count differs. Such a line is parsed again
        with an end mark as one more field: the mark lands in a named column only if fields are
        missing, which is allowed. A value with a line break in it leaves at least one line with
        another field count and an odd number of quotes.
        """
        raw = F.col(_RAW_LINE)
        again = F.from_csv(
            F.concat(raw, F.lit(self._line_options["sep"] + _END_MARK)), fields, self._line_options
        )
        # The one-element array keeps the line from being parsed once per column.
        short = F.exists(
            F.array(again), lambda row: F.lit(_END_MARK).isin(*(row[n] for n in names))
        )
        quotes = F.length(raw) - F.length(F.replace(raw, F.lit('"'), F.lit("")))
        cut_off = F.lit(not multi_line) & (quotes % 2 == 1)
        start = F.coalesce(F.col(_quoted(names[0])), F.lit(""))
        too_long = F.concat(
            F.lit(f"Expected {len(names)} fields, saw more, in row starting with "), start
        )
        broken = F.concat(
            F.lit(f"{BROKEN_RECORD}, in row starting with "), start
        )
        return (
            F.when(raw.isNull(), True)
            .when(cut_off, F.raise_error(broken).cast("boolean"))
            .when(short, True)
            .otherwise(F.raise_error(too_long).cast("boolean"))
        )

    def _typed(self, df: DataFrame) -> DataFrame:
        for name in self.parse_dates:
            text = F.col(_quoted(name))
            given = self.date_formats
            moment = _moment(text, given.get(name, ()) if isinstance(given, Mapping) else given)
            df = df.withColumns(
                {name: moment, UNPARSED + name: F.when(moment.isNull(), text)}
            )
        if self.infer_types:
            dates = {ROW, *(n for d in self.parse_dates for n in (d, UNPARSED + d))}
            df = df.withColumns(_inferred(df, [n for n in df.columns if n not in dates]))
        return df


def _moment(text: Column, formats: Sequence[str]) -> Column:
    """The text as a time without zone: ISO, or the first of the formats that fits."""
    there = text.try_cast("timestamp").cast("timestamp_ntz")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), there)
    # Most moments have no offset, and this spares them the search for one.
    end = text.substr(-8, 8)
    marked = reduce(or_, (F.contains(end, F.lit(mark)) for mark in _OFFSET_MARKS))
    iso = F.when(marked & text.rlike(_WITH_OFFSET), utc).otherwise(text.try_cast("timestamp_ntz"))
    others = (F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats)
    return F.coalesce(iso, *others)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _column_names(header: list[str | None]) -> list[str]:
    """Unique names: blank fields are numbered, repeated ones get a counter."""
    names: list[str] = []
    for i, field in enumerate(header):
        name = field or f"Unnamed: {i}"
        repeats = header[:i].count(field) if field else 0
        names.append(f"{name}.{repeats}" if repeats else name)
    return names


def _charset(encoding: str) -> str:
    """Java name of a character set given by any of its Python names."""
    try:
        name = codecs.lookup(encoding).name
    except LookupError as error:
        raise ExtractionError(f"{error}") from error
    # Names that differ between the two.
    java = {"ascii": "us-ascii", "utf-8-sig": "utf-8"}.get(name, name)
    return java.replace("iso8859", "iso-8859")


def _null_tokens(name: str) -> Column:
    text = F.col(_quoted(name))
    # Longer texts need not be looked up.
    return F.when((F.octet_length(text) > _LONGEST_TOKEN) | ~text.isin(*NULL_TOKENS), text).alias(name)


def _inferred(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Casts for the columns whose non-null values all fit a narrower type."""
    fits = {
        "bigint": lambda c: c.try_cast("bigint").isNotNull(),
        "double": lambda c: c.rlike("[0-9]$") & c.try_cast("double").isNotNull(),
        "boolean": lambda c: c.isin("True", "TRUE", "true", "False", "FALSE", "false"),
    }
    columns = {n: F.col(_quoted(n)) for n in names}
    filled = [F.count(c).alias(f"{i}_filled") for i, c in enumerate(columns.values())]
    fitting = [
        F.count_if(fit(c)).alias(f"{i}_{name}")
        for i, c in enumerate(columns.values())
        for name, fit in fits.items()
    ]
    counts = df.agg(*filled, *fitting).first()
    casts = {}
    for i, (name, column) in enumerate(columns.items()):
        rows = counts[f"{i}_filled"]
        chosen = [t for t in fits if rows and counts[f"{i}_{t}"] == rows]
        if chosen:
            casts[name] = column.try_cast(chosen[0])
    return casts
