"""Every query of the subpackage on hostile and on empty tables."""

import pytest

from spanline.llm import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_hostile(spark, hostile_data, name):
    df = plans.QUERIES[name](spark, hostile_data)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_empty(spark, empty_data, name):
    assert plans.QUERIES[name](spark, empty_data).collect() == []
