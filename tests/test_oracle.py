"""Every registered query against its DuckDB oracle (the driver's check, at small scale)."""

import pytest

from fieldpulse.plans.compare import compare, duckdb_connect
from fieldpulse.plans.registry import REGISTRY
from tests.conftest import SF_SMALL

ITEMS = REGISTRY.items()
WITH_SQL = sorted(n for n, q in ITEMS.items() if q.sql is not None)
ROWS_ONLY = sorted(n for n, q in ITEMS.items() if q.sql is None)


@pytest.fixture(scope="module")
def con():
    return duckdb_connect(SF_SMALL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, con, name):
    df = REGISTRY.callables()[name](spark, SF_SMALL)
    res = compare(df, con, ITEMS[name].sql)
    assert res["columns_match"], res
    assert res["rows_match"], res
    assert res["hash_match"], res


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_runs(spark, name):
    df = REGISTRY.callables()[name](spark, SF_SMALL)
    assert df.count() >= 1


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    # every oracle aliases its columns exactly like the Spark side
    assert set(df.columns) == {"section", "key", "measure", "value"}


def test_survey_inventory_covered():
    """Each operator id claimed by a registered query is a real SURVEY §2 id."""
    import re

    ops = {o for q in ITEMS.values() for o in q.operators}
    assert all(re.fullmatch(r"[A-Z]{1,2}-\d\d", o) for o in ops), ops
    for must in ["B-01", "B-06", "R-05", "Q-01", "Q-30", "J-01", "J-03", "C-01", "C-09",
                 "T-01", "T-05", "T-11", "S-11", "ST-01"]:
        assert must in ops
