"""All queries of this package by name, with the SQL that must give the same rows."""

from __future__ import annotations

from sparkmalt.plans import boards, catalogue, details, exports, lists, orders, runs, search, sheets, texts

MODULES = (orders, catalogue, boards, runs, texts, sheets, lists, exports, search, details)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
