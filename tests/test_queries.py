import pytest

from shelfwatch.plans import catalog

from .compare import connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    if name not in catalog.ORACLE_SQL:
        assert found.columns and found.count() >= 0
        return
    names, rows = rows_of(found)
    wanted_names, wanted = rows_of_sql(con, catalog.ORACLE_SQL[name])
    assert names == wanted_names
    assert rows == wanted


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
