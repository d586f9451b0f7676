"""Registration of queries and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def sql(views: tuple[str, ...], ctes: list[str], select: str) -> str:
    """One statement: the surrogate views, then `ctes` (each `name AS (...)`), then the final select."""
    parts = [p for p in [with_views(*views), *ctes] if p]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def r6(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"
