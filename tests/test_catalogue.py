import pytest
from compare import database, same
from conftest import SMALL

import quillrow.catalogue_parts
import quillrow.catalogue_runs  # noqa: F401
from quillrow.catalogue import DRIVER_QUERIES, DRIVER_SQL, ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    same(QUERIES[name](spark, SMALL), ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(DRIVER_QUERIES))
def test_driver_part_matches_sql(spark, con, name):
    same(DRIVER_QUERIES[name](spark, SMALL), DRIVER_SQL[name], con)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
