"""The text queries over the smallest tables: SQL where there is some, else the form of the result."""

import pytest
from compare import check

from trellisq.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    rows = check(spark, queries.QUERIES, queries.SQL, name, DIR)
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


def test_entry_adds_the_text_queries():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
