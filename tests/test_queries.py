import pytest
from compare import differs, duck

from corrie import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(queries.ALL))
def test_query_and_its_sql_twin(spark, con, name):
    assert differs(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
