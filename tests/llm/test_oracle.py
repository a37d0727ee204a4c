import pytest
from oracle import same

from orrery.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    same(queries()[name](spark, sf_dir), oracle_sql()[name], sf_dir)
