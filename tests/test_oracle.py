"""Every registered query equals its DuckDB oracle on the smallest tables
(row count, column names, order-insensitive value hash)."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

from tests.conftest import SF_SMALL

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    assert compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL, verbose=True)


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    assert len(qs) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["window_start", "window_end"]
    assert df.count() > 0


def test_rows_only_queries_run(spark):
    from scrivener.plans import registry
    for name in sorted(set(registry.QUERIES) - set(E.oracle_sql())):
        assert registry.QUERIES[name](spark, SF_SMALL).count() >= 0


def test_oracle_sql_binds_and_rounds_doubles(con):
    """Every oracle SQL binds; after the wrapper no DOUBLE column is unrounded
    (checked by binding: the wrapper keeps names and types)."""
    from scrivener.plans import registry
    for name, raw in registry.ORACLES.items():
        wrapped = E.oracle_sql()[name]
        r1, r2 = con.sql(raw), con.sql(wrapped)
        assert r1.columns == r2.columns and [str(t) for t in r1.types] == [str(t) for t in r2.types], name


def test_readme_lists_every_query():
    import os
    text = open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "README.md")).read()
    missing = [k for k in E.queries() if f"`{k}`" not in text]
    assert not missing, missing
