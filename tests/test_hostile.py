"""Every core query on hostile and on empty tables."""

import pytest

from spanline.plans import catalogue, preparation

QUERIES = catalogue.QUERIES | preparation.QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hostile(spark, hostile_data, name):
    df = QUERIES[name](spark, hostile_data)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty_data, name):
    rows = QUERIES[name](spark, empty_data).collect()
    if name not in ("inventory_consistency", "excluded_undated"):
        assert rows == []
