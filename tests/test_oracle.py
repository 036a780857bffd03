"""Every registered query against its SQL on the smallest driver tables."""

import pytest

from oracle import compare
from strikeline.catalog import load

REGISTRY = load()


@pytest.mark.parametrize("name", [n for n, e in REGISTRY.items() if e.sql])
def test_query_matches_sql(spark, duck, sf_dir, name):
    problem = compare(spark, duck, REGISTRY[name], sf_dir)
    assert problem is None, problem


@pytest.mark.parametrize("name", [n for n, e in REGISTRY.items() if not e.sql])
def test_query_without_sql_runs(spark, sf_dir, name):
    assert REGISTRY[name].run(spark, sf_dir).columns


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 120


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and all(0.0 <= r.up_rate <= 1.0 for r in rows)
