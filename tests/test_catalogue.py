import pytest
from compare import connect, duck_rows, spark_rows
from conftest import DATA

from docketry.plans import portal, stages  # noqa: F401
from docketry.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = spark_rows(QUERIES[name](spark, DATA)), duck_rows(con, ORACLE_SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
