"""Registered queries against their SQL on the smallest tables; those without SQL run whole."""

import pytest
from oracle import compare, duck

from siteprism.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    fn = catalog.QUERIES[name]
    if name in catalog.ORACLES:
        message, n = compare(spark, con, fn, catalog.ORACLES[name], SF)
        assert not message and n == (500 if name.startswith(("op11", "op13")) else 200)
    else:
        assert fn(spark, SF).count() == 200


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{i}" for i in range(1, 14)}
