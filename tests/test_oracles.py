"""Every registered query against its DuckDB oracle (the driver's gate)."""

import pytest

from conftest import SF_ORACLE
from oracle_compare import compare, duck

from pressgrid.plans.oracles import ORACLES
from pressgrid.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def con():
    c = duck(SF_ORACLE)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    problems = compare(spark, con, name, REGISTRY[name], ORACLES[name], SF_ORACLE)
    assert not problems, f"{name}: {problems}"
