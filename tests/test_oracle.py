"""Every registered query against its SQL on whole tables."""

import pytest

from oracle import compare, duck
from reelgraph.workload import load_all

REGISTRY = load_all()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(name, spark, sf, con):
    ok, message, _ = compare(spark, con, REGISTRY[name], sf)
    assert ok, message
