"""Every registered query against its SQL at the smallest scale."""

from pathlib import Path

import pytest

from checks import all_checks
from checks.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_checks()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, text = compare(spark, con, name, FOLDER)
    assert "DIFFERS" not in text, text


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() > 0
    assert rows.columns[0] == "id"
