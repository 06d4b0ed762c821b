"""Every registered query runs on the smallest scale (unbalanced panel) with a stable schema, and the
flagship entry works."""

import os

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

SLOW = {"model_ladder"}  # its parts are run by tests/test_predict.py
MAY_BE_EMPTY: set[str] = set()
MAY_BE_NULL = {"change_between_ends": {"rate_base", "rate_latest", "delta"}, "impute_scale": {"z_urgent_big_avg"}, "regex_fields": {"first_amount"}}


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n not in SLOW))
def test_query_runs_small(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns)) and "void" not in dict(df.dtypes).values()
    assert rows or name in MAY_BE_EMPTY, "no rows"
    # no column is missing throughout
    for c in set(df.columns) - MAY_BE_NULL.get(name, set()) if rows else ():
        assert any(row[c] is not None for row in rows), c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "mean_price_lag1" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
