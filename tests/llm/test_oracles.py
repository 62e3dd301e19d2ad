import pytest
from oracle_compare import compare, duck

from pressgrid.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_oracle(spark, name):
    assert not compare(spark, duck(SF), name, LLM_QUERIES[name], LLM_ORACLES[name], SF)
