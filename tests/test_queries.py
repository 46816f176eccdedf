"""Every query of the core with SQL gives what the SQL gives."""

import pytest

from tests.compare import compare, connect
from tidewire.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    why, _ = compare(spark, con, QUERIES[name], ORACLES[name], FOLDER)
    assert not why


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
