"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy leaderboard."""
    return QUERIES["policy_leaderboard"](spark, sf_dir)


def load() -> None:
    """Import the modules of queries; importing is what registers them."""
    from pitlake.plans import audits, bitemporal, intake, leaderboard, roundtrip, statistics, trading  # noqa: F401
