"""Every query of the library outside the optional training-data subpackage."""

from __future__ import annotations

import importlib

MODULES = ("motion", "tracks", "summaries", "text", "plans", "lookups", "recovery", "phases", "streams")
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"frameline.queries.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
