"""Registry of named queries: a Spark builder and, where the operator is
SQL-expressible, an independent DuckDB oracle."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    oracle: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str = "", oracle: str | None = None):
    """Decorator registering ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, oracle, tuple(c.strip() for c in covers.split(",") if c.strip()))
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from . import (ledger_queries, metrics_queries, ml_queries, scoring_queries,  # noqa: F401
                   series_queries, tree_queries, unify_queries)
    return QUERIES
