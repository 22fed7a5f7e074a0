"""Queries beside the SQL that gives the same rows."""

import pytest
from compare import connect, duck_rows, spark_rows
from conftest import DATA

from docketry.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op8_near_dedup", "op11_vector_codes", "op12_redirect_filter"])
def test_query_equals_its_sql(spark, name):
    got, want = spark_rows(QUERIES[name](spark, DATA)), duck_rows(connect(DATA), ORACLE_SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
