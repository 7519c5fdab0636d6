"""Every registered query matches its DuckDB oracle at sf0.001."""

import pytest

from paths import SF_SMALL
from oracle_check import compare, duck
from umbra.plans.catalog import oracle_sql, queries

@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    r = compare(spark, con, name, queries()[name], oracle_sql()[name], SF_SMALL)
    assert r["cols_match"], r
    assert r["hash_match"], r


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
