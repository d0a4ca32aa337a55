"""Every registered query against its reference SQL at the smallest scale."""

import pytest
from compare import connect, differences, duck_result, spark_result

from frameglass.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_reference_sql(spark, con, name):
    assert differences(spark_result(QUERIES[name](spark, SF)), duck_result(con, ORACLE[name])) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_reference_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
