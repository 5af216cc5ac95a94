"""Every query against its SQL twin on the smallest driver tables.

The hundred single-check queries are covered by ``audit_checks`` (all checks
at once); one of each unit runs on its own as well.
"""

from __future__ import annotations

import os

import pytest
from oracle import compare, duck

from siteprism.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SINGLE = {f"check_{i:03d}" for i in (2, 9, 14, 24, 26, 28, 56, 63, 98)}
NAMES = [n for n in catalog.QUERIES if not n.startswith("check_") or n in SINGLE]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    fn = catalog.QUERIES[name]
    if name in catalog.ORACLES:
        message, _ = compare(spark, con, fn, catalog.ORACLES[name], SF)
        assert not message, message
    else:
        assert fn(spark, SF).count() >= 0


def test_all_checks_registered():
    assert {f"check_{i:03d}" for i in range(1, 101)} <= set(catalog.QUERIES)
