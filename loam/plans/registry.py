"""Registry of named queries: a Spark plan and, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str


REGISTRY: dict[str, Query] = {}


def register(name: str, operators: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        text = sql() if callable(sql) else sql
        REGISTRY[name] = Query(name, fn, text, operators)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    from . import (  # noqa: F401  (imports register the queries)
        q_evals,
        q_messages,
        q_probe,
        q_responses,
        q_vectors,
    )

    return REGISTRY
