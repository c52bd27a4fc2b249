"""Text queries against their SQL at the smallest scale."""

import pytest
from sqlcheck import agree

llm = pytest.importorskip("cueweave.llm.queries")


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert agree(spark, sf, llm.QUERIES[name], llm.ORACLES[name])
