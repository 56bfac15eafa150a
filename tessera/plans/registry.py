"""The engine's queries by name and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import DUCK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *adapters: str):
    """Register a query; its SQL sees the named adapters as tables."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            views = ", ".join(f"{a} AS ({DUCK[a]})" for a in adapters)
            if views and oracle.lstrip().upper().startswith("WITH "):
                ORACLE_SQL[name] = f"WITH {views}, {oracle.lstrip()[5:]}"
            else:
                ORACLE_SQL[name] = f"WITH {views} {oracle}" if views else oracle
        return f

    return add
