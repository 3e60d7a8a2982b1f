"""Every registered query against its SQL in DuckDB, on the smallest data folder."""

import pytest
from compare import check, connect

from oddsmith.catalog import all as catalog
from oddsmith.catalog import registry

FOLDER = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(registry.ENTRIES))
def test_query(name, spark, duck):
    diff, rows, _ = check(name, spark, duck, FOLDER)
    assert diff is None, diff


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).schema.fieldNames()[0] == "condition_id"
