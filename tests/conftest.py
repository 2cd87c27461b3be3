from __future__ import annotations

import uuid

import pytest

from orderloom.session import build_session, clear_scratch
from orderloom.sinks import Warehouse


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # A folder of their own, so that two runs at once do not meet.
    warehouse = tmp_path_factory.mktemp("spark") / "warehouse"
    session = build_session(
        "orderloom-tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(warehouse),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, f"t_{uuid.uuid4().hex}_", str(tmp_path / "warehouse")).create()


def rows(df):
    """Rows as tuples in a comparable order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
