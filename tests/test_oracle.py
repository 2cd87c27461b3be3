"""Every registered query against its SQL, on the smallest test data."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from __spark_entry__ import entry  # noqa: E402
from compare import duck, expected, rows_of  # noqa: E402
from workload.catalog import QUERIES  # noqa: E402
from workload.oracle import ORACLE  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert rows_of(df.columns, df.collect()) == expected(con, ORACLE[name])


def test_entry(spark):
    assert entry(spark).count() > 0
