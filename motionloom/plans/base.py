"""How a query and the SQL that gives the same rows are kept together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function as query ``name``; ``sql`` may be left out where SQL can't say it."""

        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is taken")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
