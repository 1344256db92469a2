"""All queries of the engine by name, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLE_SQL, QUERIES

for _part in ("lookups", "joins", "aggregates", "windows", "changes", "functions", "merkle", "admission", "streams"):
    import_module(f"{__package__}.{_part}")

__all__ = ["ORACLE_SQL", "QUERIES"]
