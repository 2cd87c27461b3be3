from orderloom.sources.base import ExtractionError, Source
from orderloom.sources.delimited import DelimitedSource
from orderloom.sources.json_pages import JsonPagesSource

__all__ = ["DelimitedSource", "ExtractionError", "JsonPagesSource", "Source"]
