"""Every registered query against its SQL statement."""

import pytest

import __spark_entry__ as entry_module
import compare
from ridelens.plans import catalog

QUERIES = entry_module.queries()
STATEMENTS = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)


def check_plan(name, df):
    """Reports neither pair rows out nor run Python; rows made of literals are no work."""
    if name in catalog.queries():
        text = df._jdf.queryExecution().executedPlan().toString()
        for node in ("CartesianProduct", "NestedLoop", "Python", "ArrowEval", "InPandas"):
            assert node not in text, node


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    assert compare.differences(df, duck, STATEMENTS[name]) == []
    check_plan(name, df)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(STATEMENTS)))
def test_without_sql_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and len(df.take(1)) == 1


def test_entry(spark):
    assert entry_module.entry(spark).columns[0] == "Vehicle Type"
