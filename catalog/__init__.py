"""Registered queries: each runs a library operator over whole tables, most with SQL beside it.

The tables hold no missing cells, so dirt is put in by expressions on key columns, the same on
both sides: every row stays in, some cells are blanked, scaled or respelt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def load() -> None:
    from catalog import charts, cleaning, files, labels, plans, profiles, tables, verification  # noqa: F401
