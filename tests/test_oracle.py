"""Every registered query against its SQL in DuckDB, on the smallest data."""

import pytest

from cohortlake.plans.catalogue import CATALOGUE
from oracle_check import compare, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", [n for n, q in CATALOGUE.items() if q.sql is not None])
def test_agrees_with_sql(spark, duck, name):
    q = CATALOGUE[name]
    verdict = compare(q.run(spark, SMALL), duck, q.sql)
    assert verdict == "ok", verdict


@pytest.mark.parametrize("name", [n for n, q in CATALOGUE.items() if q.sql is None])
def test_rows_only(spark, name):
    assert CATALOGUE[name].run(spark, SMALL).collect()


def test_entry(spark):
    from __spark_entry__ import FLAGSHIP, entry, oracle_sql, queries

    assert FLAGSHIP in queries() and set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
