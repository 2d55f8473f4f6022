"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from podium.roles import Tables, with_roles

BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a builder; ``sql`` may name roles, which are added as CTEs."""

    def wrap(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        BUILDERS[name] = build
        if sql is not None:
            ORACLES[name] = with_roles(sql)
        return build

    return wrap


def runner(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    return run
