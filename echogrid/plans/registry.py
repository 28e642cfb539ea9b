"""All registered queries of the radar operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.plans.relations import with_relations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, relations: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` follows the ``WITH`` of the named relations. A name is used once."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_relations(relations, sql) if relations else sql
        return f

    return put


def r6(x: Column) -> Column:
    """Rounded for comparison, never a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def load() -> None:
    """Import every module that registers queries."""
    from echogrid.plans import blocks, cells, estimates, geometry, mapping, native, neighbourhoods, products, series, signals  # noqa: F401


