"""Every point-cloud query against its SQL at sf0.001."""

import pytest
from tests.compare import same
from tests.conftest import SMALL

from pointwright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SMALL), duck, registry.ORACLE_SQL[name])


def test_every_query_runs(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)):
        assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 10
