"""The registered queries: a name has a DataFrame form and, where possible, one in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from . import views as V

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable:
    """Registers a function of a session and a folder of tables."""

    def put(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = V.sql(sql)
        return f

    return put
