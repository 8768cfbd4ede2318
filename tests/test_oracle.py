"""Every registered query against its SQL on the given tables (TEST_SF_DIR picks the scale)."""

import pytest

import __spark_entry__ as driver
from compare import differences, oracle_connection

from workload import oracles, queries as registry

# No station reaches the default 1,000 parts in the smallest tables.
MAY_BE_EMPTY = {"station_table", "top_stations"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_query_has_an_oracle():
    assert set(registry.registered()) == set(oracles.oracle_sql())


def test_entry_returns_rows(spark):
    assert driver.entry(spark).count() == 52


@pytest.mark.parametrize("name", sorted(registry.registered()))
def test_query_matches_oracle(spark, con, sf_dir, name):
    found = differences(registry.registered()[name](spark, sf_dir), con, oracles.oracle_sql()[name])
    if name in MAY_BE_EMPTY and found == "no rows on either side":
        return
    assert found is None
