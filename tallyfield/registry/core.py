"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfield.registry.views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; `views` names the shared SQL views its check needs, space-separated."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, views.split())
        return function

    return add


def with_views(sql: str, names: list[str]) -> str:
    """Prepend the named views and all views these use."""
    needed: dict[str, str] = {}

    def need(name: str) -> None:
        if name in needed:
            return
        uses, body = VIEWS[name]
        for other in uses:
            need(other)
        needed[name] = body

    for name in names:
        need(name)
    head = ",\n".join(f"{n} AS ({b})" for n, b in needed.items())
    sql = sql.strip()
    if not head:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{sql[len('WITH RECURSIVE'):]}"
    if sql.upper().startswith("WITH"):
        return f"WITH {head},\n{sql[len('WITH'):]}"
    return f"WITH {head}\n{sql}"
