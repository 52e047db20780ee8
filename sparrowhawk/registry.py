"""All registered queries of the library with their SQL oracles."""

from __future__ import annotations

from .plans import finding_queries, session_queries, source_queries, supply_queries, text_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (text_queries, finding_queries, session_queries, supply_queries, source_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
