"""Registered queries against their SQL on the smallest tables.

Set SHELFWISE_ALL=1 to run every query with SQL; the default takes the first two of each family.
"""

import os

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR

ORACLES, QUERIES = entry.oracle_sql(), entry.queries()


def chosen():
    if os.environ.get("SHELFWISE_ALL"):
        return sorted(ORACLES)
    seen: dict[str, list[str]] = {}
    for name in sorted(ORACLES):
        seen.setdefault(name[0], []).append(name)
    return [n for names in seen.values() for n in names[:2]]


@pytest.mark.parametrize("name", chosen())
def test_matches_sql(spark, con, name):
    import check

    ok, message, _, _ = check.compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1
