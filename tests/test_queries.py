"""Every named query against its SQL, or at least to the end."""

from __future__ import annotations

import pytest

from oracle import compare, connect
from txquality.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", ["lr_scores", "model_metrics", "stream_scores"])
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 24
    assert set(entry.oracle_sql()) <= set(entry.queries())
