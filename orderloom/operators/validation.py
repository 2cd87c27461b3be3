"""Row validation as column expressions: no row loop, no shuffle, no Python on the workers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    NumericType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from orderloom.operators.records import RECORDS, Field, Kind, Record
from orderloom.sources.base import ROW
from orderloom.sources.delimited import UNPARSED

MODES = ("strict", "filter", "flag")

_WIDE = "decimal(38,18)"
_BEYOND_WIDE = 1e20
_ERROR_TYPE = "array<struct<field:string,rule:string,value:string>>"
_VALID = "_row_passes"
_ROW_ID = "_row_id"
_PARSED = "_parsed_"


@dataclass(frozen=True)
class CheckedField:
    """A field's typed value and its checks, in the order in which the first failure is reported.

    ``parsed`` are columns that have to be added to the frame first. They are referred to more
    than once, and as columns they are parsed once per row.
    """

    field: Field
    value: Column
    shown: Column
    checks: list[tuple[str, Column]]
    parsed: dict[str, Column]

    @property
    def passes(self) -> Column:
        return reduce(lambda a, b: a & b, (ok for _, ok in self.checks), F.lit(True))

    @property
    def error(self) -> Column:
        """Struct of field, first broken rule and value; null if all rules hold."""
        broken = F
        for rule, ok in self.checks:
            broken = broken.when(
                ~ok,
                F.struct(
                    F.lit(self.field.name).alias("field"),
                    F.lit(rule).alias("rule"),
                    self.shown.alias("value"),
                ),
            )
        return broken.otherwise(F.lit(None)) if self.checks else F.lit(None)


def check_field(field: Field, schema: StructType) -> CheckedField:
    """Typed value and checks of one field, given the types of the frame it is in."""
    if field.name not in schema.names:
        checks = [("missing", F.lit(False))] if field.required else []
        null = F.lit(None)
        return CheckedField(field, null.cast(field.kind.value), null.cast("string"), checks, {})

    raw = F.col(f"`{field.name}`")
    kind = schema[field.name].dataType
    if isinstance(kind, (DoubleType, FloatType)):
        raw = F.when(~F.isnan(raw), raw)
    convert = {
        Kind.TEXT: _text,
        Kind.MONEY: _money,
        Kind.WHOLE: _whole,
        Kind.MOMENT: _moment,
    }[field.kind]
    parsed: dict[str, Column] = {}
    value, checks = convert(field, raw, kind, parsed)
    if field.required:
        checks.insert(0, ("required", raw.isNotNull()))
    shown = raw.cast("string")
    helper = UNPARSED + field.name
    if helper in schema.names:
        unparsed = F.col(f"`{helper}`")
        checks.append(("datetime", unparsed.isNull()))
        shown = F.coalesce(shown, unparsed)
    return CheckedField(field, value, shown, checks, parsed)


def _holds(condition: Column) -> Column:
    """A check never fails on null; ``required`` covers that."""
    return F.coalesce(condition, F.lit(True))


def _text(field: Field, raw: Column, kind, parsed) -> tuple[Column, list]:
    if not isinstance(kind, StringType):
        return raw.cast("string"), [("text", raw.isNull())]
    checks = []
    if field.min_length is not None:
        checks.append(("min_length", _holds(F.length(raw) >= field.min_length)))
    if field.pattern is not None:
        checks.append(("pattern", _holds(raw.rlike(field.pattern))))
    if field.one_of:
        checks.append(("one_of", _holds(raw.isin(*field.one_of))))
    return (F.lower(raw) if field.lower else raw), checks


@dataclass(frozen=True)
class _Number:
    """Ways to look at a number. ``quick`` is the loaded value where a plain cast finds it.

    Nearly all rows are settled by it; the exact decimal is only computed for the others.
    """

    raw: Column
    quick: Column
    exact: Column
    rough: Column

    @property
    def is_number(self) -> Column:
        # A number too large to be exact is still a number; it fails later for its size.
        huge = ~F.isnan(self.rough) & (F.abs(self.rough) >= _BEYOND_WIDE)
        return self.or_null(
            self.quick.isNotNull() | self.exact.isNotNull() | F.coalesce(huge, F.lit(False))
        )

    def or_null(self, condition: Column) -> Column:
        return self.raw.isNull() | condition

    def bounds(self, field: Field) -> list[tuple[str, Column]]:
        size = F.coalesce(self.exact, F.signum(self.rough))
        # A number too small for the exact decimal is zero there; the double still has its sign.
        tiny = F.coalesce((self.exact == 0) & (self.rough > 0), F.lit(False))
        checks = []
        for rule, limit, reached in (
            ("greater_than", field.above, size > field.above),
            ("at_least", field.at_least, size >= field.at_least),
        ):
            if limit is not None:
                # The loaded value is rounded, so it only settles what is above the limit.
                beyond = F.coalesce(self.quick > limit, F.lit(False))
                positive = tiny if limit == 0 else F.lit(False)
                checks.append((rule, _holds(beyond | positive | reached)))
        return checks

    @property
    def is_integral(self) -> Column:
        same = self.exact.try_cast(Kind.WHOLE.value) == self.exact
        return self.or_null(self.quick.isNotNull() | F.coalesce(same, F.lit(False)))


def _number(field: Field, raw: Column, kind, parsed) -> _Number:
    """Text goes straight to decimal, so money is rounded half up in base ten."""
    if isinstance(kind, StringType):
        quick = _parsed(parsed, field, raw.try_cast(field.kind.value))
        return _Number(raw, quick, raw.try_cast(_WIDE), raw.try_cast("double"))
    none = F.lit(None).cast(field.kind.value)
    if isinstance(kind, (IntegralType, DecimalType)):
        return _Number(raw, none, raw, raw.cast("double"))
    return _Number(raw, none, _parsed(parsed, field, raw.try_cast(_WIDE)), raw.try_cast("double"))


def _money(field: Field, raw: Column, kind, parsed) -> tuple[Column, list]:
    number = _number(field, raw, kind, parsed)
    value = F.coalesce(number.quick, number.exact.try_cast(field.kind.value))
    fits = number.or_null(value.isNotNull())
    return value, [("number", number.is_number), *number.bounds(field), ("finite", fits)]


def _whole(field: Field, raw: Column, kind, parsed) -> tuple[Column, list]:
    number = _number(field, raw, kind, parsed)
    value = F.coalesce(number.quick, number.exact.try_cast(field.kind.value))
    checks = [("number", number.is_number), ("integer", number.is_integral)]
    return value, [*checks, *number.bounds(field)]


def _moment(field: Field, raw: Column, kind, parsed) -> tuple[Column, list]:
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return raw.cast(field.kind.value), []
    if isinstance(kind, NumericType):
        return F.lit(None).cast(field.kind.value), [("datetime", raw.isNull())]
    value = _parsed(parsed, field, raw.try_cast(field.kind.value))
    return value, [("datetime", raw.isNull() | value.isNotNull())]


def _parsed(parsed: dict[str, Column], field: Field, value: Column) -> Column:
    name = _PARSED + field.name
    parsed[name] = value
    return F.col(f"`{name}`")


def with_parsed(df: DataFrame, fields: Iterable[CheckedField]) -> DataFrame:
    """The frame with the columns that the values and checks of the fields refer to."""
    columns = {name: value for f in fields for name, value in f.parsed.items()}
    return df.withColumns(columns) if columns else df


@dataclass(frozen=True)
class Checked:
    """Result of a validation that counts; both frames are lazy.

    ``counts`` holds ``valid`` and ``rejected`` once an action has read all of ``rows``, so a
    load and its counts need one pass.
    """

    rows: DataFrame
    rejects: DataFrame
    counts: Observation


class SchemaValidator:
    """Checks frames against record schemas.

    Modes: ``filter`` keeps valid rows, ``flag`` keeps all rows and adds ``_is_valid`` and
    ``_validation_errors``, ``strict`` raises ``ValueError`` for the first invalid row. Columns
    that are not in the schema are kept; absent optional columns are added as null.
    """

    def __init__(self, mode: str = "filter", records: Mapping[str, Record] = RECORDS):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {mode}")
        self.mode = mode
        self.records = records

    def get_schema_columns(self, schema_name: str) -> list[str]:
        return self._record(schema_name).columns

    def validate(self, df: DataFrame, schema_name: str) -> tuple[DataFrame, DataFrame]:
        """Rows that stay, and one report row per invalid row; both are lazy."""
        return self.rows(df, schema_name), self.rejects(df, schema_name)

    def rows(self, df: DataFrame, schema_name: str) -> DataFrame:
        """The rows that stay."""
        fields = self._fields(df, schema_name)
        return self._shape(_judged(df, fields), fields)

    def rejects(self, df: DataFrame, schema_name: str) -> DataFrame:
        """Row id, broken rules and original data of each invalid row."""
        return _rejects(df, [check_field(f, df.schema) for f in self._record(schema_name).fields])

    def check(self, df: DataFrame, schema_name: str) -> Checked:
        """As ``validate``, with counts taken while the rows are read."""
        fields, counts = self._fields(df, schema_name), Observation()
        observed = _judged(df, fields).observe(
            counts,
            F.count_if(_VALID).alias("valid"),
            F.count_if(~F.col(_VALID)).alias("rejected"),
        )
        return Checked(self._shape(observed, fields), _rejects(df, fields), counts)

    def _shape(self, judged: DataFrame, fields: list[CheckedField]) -> DataFrame:
        return _flagged(judged, fields) if self.mode == "flag" else _valid_only(judged, fields)

    def _fields(self, df: DataFrame, schema_name: str) -> list[CheckedField]:
        """The checks of a record; in strict mode, only if there is no invalid row."""
        fields = [check_field(f, df.schema) for f in self._record(schema_name).fields]
        if self.mode == "strict":
            _raise_first(_rejects(df, fields))
        return fields

    def _record(self, schema_name: str) -> Record:
        if schema_name not in self.records:
            raise ValueError(f"No record is named {schema_name}")
        return self.records[schema_name]


def _passes(fields: list[CheckedField]) -> Column:
    return reduce(lambda a, b: a & b, (f.passes for f in fields), F.lit(True))


def _judged(df: DataFrame, fields: list[CheckedField]) -> DataFrame:
    return with_parsed(df, fields).withColumn(_VALID, _passes(fields))


def _errors(fields: list[CheckedField]) -> Column:
    return F.array_compact(F.array(*(f.error for f in fields))).cast(_ERROR_TYPE)


def _valid_only(judged: DataFrame, fields: list[CheckedField]) -> DataFrame:
    """Valid rows with normalised values. Unparsed helper columns are null in them, so they go."""
    values = {f.field.name: f.value for f in fields}
    gone = {_VALID, *(UNPARSED + name for name in values), *(n for f in fields for n in f.parsed)}
    kept = [c for c in judged.columns if c not in gone]
    return judged.where(_VALID).select(
        *(values[c].alias(c) if c in values else F.col(f"`{c}`") for c in kept),
        *(v.alias(n) for n, v in values.items() if n not in kept),
    )


def _flagged(judged: DataFrame, fields: list[CheckedField]) -> DataFrame:
    """All rows; invalid ones keep their values, so the columns keep their input types."""
    types = {f.name: f.dataType for f in judged.schema.fields}
    values = {f.field.name: f.value for f in fields}

    def shown(name: str) -> Column:
        column = F.col(f"`{name}`")
        if name not in values:
            return column
        normal = values[name].try_cast(types[name])
        return F.when(F.col(_VALID), normal).otherwise(column).alias(name)

    gone = {_VALID, *(n for f in fields for n in f.parsed)}
    return judged.select(
        *(shown(c) for c in judged.columns if c not in gone),
        *(v.alias(n) for n, v in values.items() if n not in types),
        F.col(_VALID).alias("_is_valid"),
        F.when(~F.col(_VALID), F.to_json(_errors(fields))).alias("_validation_errors"),
    )


def _rejects(df: DataFrame, fields: list[CheckedField]) -> DataFrame:
    """Row id, broken rules and original data of each invalid row.

    The id is the row's number in its source, where the frame has it (``_row``). Otherwise ids ascend in
    reading order but are not contiguous. Error arrays are built after the filter, for invalid rows only.
    """
    number = F.col(ROW) if ROW in df.columns else F.monotonically_increasing_id()
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != ROW))
    data = F.to_json(row, {"ignoreNullFields": "false"})
    return (
        with_parsed(df.withColumn(_ROW_ID, number), fields)
        .where(~_passes(fields))
        .select(_ROW_ID, _errors(fields).alias("_errors"), data.alias("_data"))
    )


def _raise_first(rejects: DataFrame) -> None:
    first = rejects.orderBy(_ROW_ID).limit(1).collect()
    if first:
        broken = ", ".join(f"{e.field}: {e.rule} ({e.value})" for e in first[0]["_errors"])
        raise ValueError(f"First invalid row breaks {broken}")


def rule_counts(rejects: DataFrame) -> DataFrame:
    """Number of broken rules by field and rule."""
    # No reject is without errors, so the outer form drops nothing; it saves a second evaluation.
    broken = rejects.select(F.explode_outer("_errors").alias("e")).select("e.field", "e.rule")
    return broken.groupBy("field", "rule").agg(F.count(F.lit(1)).alias("n"))
