"""Every query outside the text subpackage against its SQL, over the whole smallest tables."""

import pytest
from compare import check

from trellisq.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    check(spark, registry.QUERIES, registry.SQL, name, DIR)


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES
