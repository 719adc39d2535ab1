"""The registered queries, and for each the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("versions", "index", "graph", "corpus", "telemetry", "settings", "streams", "files")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for group in GROUPS:
        part = getattr(import_module(f"supplyscope.registry.{group}"), attribute)
        twice = merged.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracle_sql() -> dict:
    return _collect("ORACLE")
