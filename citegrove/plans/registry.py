"""Registry that pairs every query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None


class Registry:
    """Named queries; sql is None where ANSI SQL can't express the operator."""

    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            if name in self._entries:
                raise ValueError(f"query {name} is registered twice")
            self._entries[name] = Entry(name, f, sql)
            return f

        return keep

    def queries(self) -> dict[str, Query]:
        return {k: e.run for k, e in self._entries.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {k: e.sql for k, e in self._entries.items() if e.sql}


#: The core's queries.
REGISTRY = Registry()
