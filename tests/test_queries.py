"""Every registered query against its oracle SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from podium.plans import load
from podium.plans.registry import BUILDERS
from tests.oracle import DATA, compare, connect

SF_DIR = f"{DATA}/sf0.001"
load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(BUILDERS))
def test_query(spark, con, name):
    problems = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    # the smallest scale may leave a rare case without rows
    assert [p for p in problems if not p.startswith("no rows")] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(BUILDERS) <= set(entry.oracle_sql()) <= set(entry.queries())
