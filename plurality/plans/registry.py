"""Registered queries: a name, a plan over the tables of a folder, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plurality.sources.adapters import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, views: bool = True):
    """Registers the function under its name; ``views`` puts the adapter views before the SQL.

    The SQL is written for a SQL engine on its own, not derived from the plan.
    """

    def register(plan):
        QUERIES[plan.__name__] = plan
        if oracle:
            text = oracle.strip()
            if views:
                joined = f"{SQL.strip()}, {text[5:]}" if text.upper().startswith("WITH ") else f"{SQL.strip()}\n{text}"
                text = f"WITH {joined}"
            ORACLES[plan.__name__] = text
        return plan

    return register
