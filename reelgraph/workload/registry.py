"""The registry behind ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from reelgraph.sources.driver_tables import with_views

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None
    rows: tuple[str, ...]  # rows of the operator inventory it exercises


REGISTRY: dict[str, Query] = {}


def query(name: str, rows: str, sql: str | None = None, views: str = "") -> Callable[[Run], Run]:
    """Register a query; ``views`` names the mapped tables its SQL refers to."""

    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        text = with_views(sql, *views.split()) if sql is not None else None
        REGISTRY[name] = Query(name, run, text, tuple(rows.split()))
        return run

    return register
