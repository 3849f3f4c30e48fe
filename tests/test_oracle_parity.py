"""Every registered query with an oracle matches DuckDB at sf0.01 (what the driver checks)."""

import pytest

import __spark_entry__ as entry
from stancelab.plans import oracle_sql
from tests.conftest import SF_CHECK
from tests.parity import compare, duck

ORACLES = oracle_sql.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    problems = compare(spark, con, name, SF_CHECK, entry.queries()[name], ORACLES[name])
    assert not problems, problems


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "direction" in df.columns
