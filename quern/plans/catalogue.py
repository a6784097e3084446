"""Every registered relational query with its SQL twin (None where SQL cannot express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import bandit_queries, bar_queries, cleaning_queries, feature_queries, incremental_queries, model_queries

Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]
_ALL: dict[str, Entry] = {}
for _module in (bar_queries, cleaning_queries, feature_queries, bandit_queries, incremental_queries, model_queries):
    _ALL |= _module.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
