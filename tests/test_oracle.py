"""The correctness gate: every registered query equals its DuckDB oracle."""

import pytest

from conftest import SMOKE

from __spark_entry__ import oracle_sql, queries
from burstlens.plans.registry import QUERIES

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    from tools.compare import duck as make
    return make(SMOKE)


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(queries()) and set(KEYS) <= set(oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    from tools.compare import compare
    problems, _, _ = compare(spark, duck, key, queries()[key], oracle_sql()[key], SMOKE)
    assert not problems, problems


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    rows = entry(spark).collect()
    assert len(rows) == 1 and rows[0]["total_events"] > 0
