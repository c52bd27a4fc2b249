"""Every core query against its SQL at the smallest scale."""

import pytest
from sqlcheck import agree

from cueweave.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert agree(spark, sf, catalog.QUERIES[name], catalog.ORACLES[name])
