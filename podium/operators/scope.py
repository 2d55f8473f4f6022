"""Predicates and filters that set the scope of a metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of entries that did not come to the start.
NO_SHOW = ("DNS", "DNC")


def showed_up(status: str = "status") -> Column:
    """Finished, or came to the start; retired and disqualified entries still count."""
    return F.col(status).isNull() | ~F.col(status).isin(*NO_SHOW)


def clean_finish(rank: str = "rank", status: str = "status") -> Column:
    return F.col(rank).isNotNull() & (F.col(status).isNull() | (F.col(status) == ""))


def exclude(df: DataFrame, *skips: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in none of the skip sets. Spark broadcasts a skip set only if it measures small."""
    for skip in skips:
        df = df.join(skip.select(on).distinct(), on, "left_anti")
    return df
