"""Ingestion run: read files, validate rows, append the valid ones to the raw tables."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame

from orderloom.operators.validation import SchemaValidator
from orderloom.session import together
from orderloom.sinks import LoadError, Warehouse
from orderloom.sources import DelimitedSource
from orderloom.sources.base import SPARK_ERRORS
from orderloom.sources.delimited import BROKEN_RECORD

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class Job:
    name: str
    file: str
    table: str
    schema: str = "raw"
    date_columns: tuple[str, ...] = ()
    multi_line: bool | None = None
    date_formats: tuple[str, ...] | None = None
    day_first: bool = False


JOBS = (
    Job("customers", "customers.csv", "customers", date_columns=("created_at",)),
    Job("products", "products.csv", "products"),
    Job("orders", "orders.csv", "orders", date_columns=("order_date",)),
)


#: What the name of a table of rejects ends in.
_REJECTS = "_rejects"


@dataclass
class RunReport:
    start_time: datetime | None = None
    end_time: datetime | None = None
    tables_processed: int = 0
    rows_loaded: int = 0
    rows_rejected: int = 0
    errors: list[dict[str, str]] = field(default_factory=list)

    @property
    def failed(self) -> bool:
        """Rejected rows alone do not make a run fail."""
        return bool(self.errors)


class IngestRun:
    """Runs the jobs; a failed job is reported and the others go on.

    Jobs of different tables are submitted together, as a small file has fewer tasks than there are slots. Those that
    append to one table run one after another, in the order given, which is also the order of the errors.

    ``rejects_schema`` names a layer in which invalid rows are kept as ``<table>_rejects`` with their row numbers
    in the file. That takes a second pass over the file, and one that numbers its rows; without it they are only
    counted, while the rest is loaded.

    A file is first read as if no record had line breaks, which saves the search for them. If one has,
    nothing is loaded, and the file is read again with the breaks (unless the job rules them out).
    """

    def __init__(
        self,
        warehouse: Warehouse,
        data_dir: str,
        jobs: Sequence[Job] = JOBS,
        rejects_schema: str | None = None,
        loaded_at: datetime | None = None,
    ):
        self.warehouse = warehouse
        self.data_dir = str(data_dir).rstrip("/")
        self.jobs = jobs
        self.rejects_schema = rejects_schema
        self.loaded_at = loaded_at
        self.validator = SchemaValidator("filter")

    def run(self) -> RunReport:
        report = RunReport(start_time=datetime.now())
        parts = [RunReport() for _ in self.jobs]
        turns: dict[str, list[int]] = {}
        for i, job in enumerate(self.jobs):
            # A table goes with the tables that its rejects may be appended to.
            turns.setdefault(re.sub(f"({_REJECTS})+$", "", job.table.lower()), []).append(i)

        def in_turn(places: list[int]) -> None:
            for i in places:
                self._run_job(self.jobs[i], parts[i])

        together(self.warehouse.spark, *(partial(in_turn, places) for places in turns.values()))
        for part in parts:
            report.tables_processed += part.tables_processed
            report.rows_loaded += part.rows_loaded
            report.rows_rejected += part.rows_rejected
            report.errors += part.errors
        report.end_time = datetime.now()
        logger.info("Ingestion: %s", report)
        return report

    def _run_job(self, job: Job, report: RunReport) -> None:
        try:
            self._process(job, report)
            report.tables_processed += 1
        except Exception as error:  # any failure is this job's alone
            logger.error("Job %s failed: %s", job.name, error)
            report.errors.append({"job": job.name, "error": str(error)})

    def _process(self, job: Job, report: RunReport) -> None:
        try:
            self._load(job, report, bool(job.multi_line))
        except LoadError as error:
            if job.multi_line is not None or BROKEN_RECORD not in str(error):
                raise
            self._load(job, report, True)

    def _load(self, job: Job, report: RunReport, multi_line: bool) -> None:
        source = DelimitedSource(
            self.warehouse.spark,
            f"{self.data_dir}/{job.file}",
            source_name=f"csv_{job.name}",
            parse_dates=job.date_columns,
            multi_line=multi_line,
            date_formats=job.date_formats,
            day_first=job.day_first,
            number_rows=self.rejects_schema is not None,
        )
        checked = self.validator.check(source.extract(self.loaded_at), job.name)
        try:
            report.rows_loaded += self.warehouse.load(checked.rows, job.table, job.schema)
        except LoadError:
            # Rejects count even if the load fails; the load did not get to count them.
            report.rows_rejected += _count_readable(checked.rejects)
            raise
        report.rows_rejected += checked.counts.get["rejected"]
        if self.rejects_schema:
            self.warehouse.load(checked.rejects, f"{job.table}{_REJECTS}", self.rejects_schema)


def _count_readable(rejects: DataFrame) -> int:
    """Number of rejects; none if the file itself is what could not be read."""
    try:
        return rejects.count()
    except SPARK_ERRORS:
        return 0
