"""All registered queries of the timeline operators, with the SQL that each must equal."""

from __future__ import annotations

from . import model_queries, more_queries, source_queries, timeline_queries, value_queries
from .registry import ORACLES, QUERIES

MODULES = (timeline_queries, value_queries, model_queries, more_queries, source_queries)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
