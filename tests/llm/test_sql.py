import pytest
from conftest import same

from weftline.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert same(spark, duck, QUERIES[name], SQL[name])
