"""Where query modules register what they offer."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``, with its SQL if there is one."""

    def add(call):
        QUERIES[name] = call
        if sql:
            ORACLES[name] = sql
        return call

    return add
