"""Where queries and their oracles are registered."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame, and DuckDB SQL for the same rows."""

    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep
