"""Every query of the change-data engine against its DuckDB SQL."""

import oracle
import pytest

from changeloom.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert sorted(registry.queries()) == sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_sql(spark, name):
    assert oracle.difference(spark, SMALL, registry.queries()[name], registry.oracle_sql()[name]) == ""
