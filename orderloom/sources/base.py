"""What every source has in common: a name, a lazy frame, and load metadata."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The number of a row in its source, from 0. It is no data: loads leave it out.
ROW = "_row"


class ExtractionError(Exception):
    """A source is missing or cannot be read."""


class Source(ABC):
    """A named source. New sources subclass this and implement ``extract``."""

    def __init__(self, source_name: str):
        self.source_name = source_name

    @abstractmethod
    def extract(self) -> DataFrame:
        """Return the records with load metadata, or raise ``ExtractionError``."""

    def add_metadata(self, df: DataFrame, loaded_at: datetime | None = None) -> DataFrame:
        """Add ``_loaded_at`` and ``_source``.

        The time is taken once on the driver, so that task retries and re-evaluation agree.
        """
        moment = loaded_at or datetime.now()
        return df.withColumns(
            {
                "_loaded_at": F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz"),
                "_source": F.lit(self.source_name),
            }
        )

    def validate_schema(self, df: DataFrame, required_columns: Iterable[str]) -> bool:
        """True if all required columns are there, else ``ValueError`` naming the missing ones."""
        missing = sorted(set(required_columns) - set(df.columns))
        if missing:
            raise ValueError(f"Columns not found: {missing}")
        return True


# What a failed Spark job or analysis raises.
SPARK_ERRORS = (PySparkException, Py4JJavaError)


def reason(error: Exception) -> str:
    """The message of a Spark error with that of its cause, without the JVM stack traces."""
    if not isinstance(error, Py4JJavaError):
        return _first_line(str(error))
    thrown, lines = error.java_exception, []
    while thrown is not None and len(lines) < 2:
        lines.append(_first_line(str(thrown.getMessage())))
        thrown = thrown.getCause()
    return "; ".join(lines)


def _first_line(text: str) -> str:
    return text.strip().split("\n")[0]
