"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from . import cell_queries, more_queries, panel_queries, scale_queries, serve_queries, text_queries
from .registry import QueryFn

_PARTS = (panel_queries.R, serve_queries.R, text_queries.R, more_queries.R, scale_queries.R, cell_queries.R)


def queries() -> dict[str, QueryFn]:
    return {name: fn for part in _PARTS for name, fn in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}
