from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from podium.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row."""

    def value(column, row: str = "SELECT 1"):
        got = spark.sql(row).select(column.alias("v")).first()["v"]
        return got.asDict() if hasattr(got, "asDict") else got

    return value
