"""Command line: ``spark-submit orderloom_job.py`` or ``python -m orderloom <step> --data-dir DIR``."""

from __future__ import annotations

import argparse
import logging
import sys

from orderloom.operators.quality import run_suite
from orderloom.plans.checks import DECLARED
from orderloom.runs import IngestRun, build_models, run_all
from orderloom.session import build_session
from orderloom.sinks import Warehouse


def main(argv: list[str] | None = None) -> int:
    """Exit status 1 if an ingestion job or a data test failed."""
    parser = argparse.ArgumentParser(prog="orderloom")
    parser.add_argument("step", choices=("ingest", "build", "test", "all"))
    parser.add_argument("--data-dir", default="data", help="folder of the three input files")
    parser.add_argument("--location", help="folder of the tables")
    parser.add_argument("--prefix", default="", help="prefix of the database names")
    parser.add_argument("--as-of", help="date the customer activity is seen from")
    parser.add_argument("--fact-partitions", nargs="*", default=(), help="such as order_year")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)

    warehouse = Warehouse(build_session(), args.prefix, args.location).create()
    if args.step == "ingest":
        return int(IngestRun(warehouse, args.data_dir).run().failed)
    if args.step == "build":
        build_models(warehouse, args.as_of, fact_partitions=tuple(args.fact_partitions))
        return 0
    if args.step == "test":
        names = sorted({check.table for check in DECLARED})
        tables = {n: warehouse.table(n.split(".")[1], n.split(".")[0]) for n in names}
        # One row per declared test.
        results = run_suite(tables, DECLARED).collect()
        for row in results:
            print(row["status"], row["test"], f"{row['table']}.{row['column']}", row["failures"])
        return int(any(row["status"] == "fail" for row in results))
    outcome = run_all(warehouse, args.data_dir, args.as_of, tuple(args.fact_partitions))
    for failure in outcome.failed_tests:
        logging.error("Data test failed: %s", failure)
    return int(not outcome.succeeded)


if __name__ == "__main__":
    sys.exit(main())
