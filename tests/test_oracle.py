"""Every query with an oracle gives the oracle's rows; the others run."""

import pytest

import __spark_entry__ as entry
import oracle

SF = f"{oracle.BASE}/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert oracle.difference(spark, name, QUERIES[name], SQL[name], SF, con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
