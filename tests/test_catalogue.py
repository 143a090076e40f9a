"""Every query of the catalogue against its SQL in DuckDB."""

import pytest

from loomwork import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, oracle, same, name):
    same(catalogue.QUERIES[name](spark, SMALL), oracle(catalogue.ORACLES[name]))


def test_all_have_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()
