"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import compare

from tessaria.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    assert compare(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_sql_twin(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0
