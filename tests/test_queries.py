"""Every registered query against its SQL, on the smallest tables."""
import os

import pytest

from compare import compare, connect
from scanloom.plans.queries import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got, want, _, _, problem = compare(spark, duck, name, QUERIES[name], SQL.get(name), FOLDER)
    assert problem is None
    assert got or name in ("generic_findings_conversations", "go_findings_documents")


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
