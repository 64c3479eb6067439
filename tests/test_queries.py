"""Every registered query against its SQL on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry_module
from jetframe import plans

SF = "/root/testdata/sf0.001"
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(plans.registry()))
def test_query(spark, duck, name):
    good, text = check.compare(
        spark, duck, SF, name, entry_module.queries()[name], ORACLES.get(name)
    )
    assert good, text
