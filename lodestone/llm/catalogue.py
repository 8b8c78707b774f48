"""The subpackage's queries and SQL by name."""

from __future__ import annotations

from . import leaks, matching, names, neighbours, packing, spans, splitting, survivor

MODULES = (neighbours, matching, names, survivor, splitting, packing, leaks, spans)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
