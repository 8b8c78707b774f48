"""The queries of the core library by name."""

from __future__ import annotations

from ..operators import communities, evaluation, extraction, graph, orphans, paths, resolution, retrieval, search, templates
from ..sources import archive
from . import more_queries, stream_queries, text_queries

MODULES = (orphans, text_queries, extraction, graph, paths, templates, resolution, communities, retrieval, search, evaluation, archive, stream_queries, more_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
