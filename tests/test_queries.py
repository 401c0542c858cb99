"""Every core query against its DuckDB oracle; those without one must give rows."""

import pytest

from limnos.plans import registry
from oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.ORACLES:
        assert compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF) > 0
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0
