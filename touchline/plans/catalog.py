"""All queries, and the SQL of those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly, crosschecks, decisions, depth, desk, ingest, ledger, matchup, models, newsroom, profiles, results, rules, text

MODULES = [results, ledger, ingest, models, text, profiles, crosschecks, rules, assembly, decisions, desk, matchup, newsroom, depth]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, (_, text) in module.QUERIES.items() if text}
