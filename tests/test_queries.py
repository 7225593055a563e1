"""Every query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
# Model jobs take longest; test_models covers their parts.
FITTED = {n for n in entry.queries() if n not in entry.oracle_sql()} - {"sample_5pct"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - FITTED))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in entry.oracle_sql():
        problems, _ = compare(df, duck, entry.oracle_sql()[name])
        assert not problems
    else:
        assert 0 < df.count() < 300


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_a_yearly_share(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 7 and all(r.correct_with_baseline is None or 0 <= r.correct_with_baseline <= 1 for r in rows)
