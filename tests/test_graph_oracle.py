import pytest
from oracle import same

from orrery.plans.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_matches_sql(spark, sf_dir, name):
    same(queries()[name](spark, sf_dir), oracle_sql()[name], sf_dir)
