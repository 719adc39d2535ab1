"""A small decorator to register a query together with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from supplyscope.adapters import with_relations


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, uses: tuple[str, ...] = (), sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = (with_relations(*uses) if uses else "") + _join_with(sql, bool(uses))
            return fn

        return register


def _join_with(sql: str, follows: bool) -> str:
    """A check that starts with its own WITH continues the WITH of the relations."""
    text = sql.strip()
    if follows and text.lower().startswith("with recursive "):
        raise ValueError("put 'recursive' checks in a subquery or build the clause by hand")
    return ", " + text[5:] if follows and text.lower().startswith("with ") else text
