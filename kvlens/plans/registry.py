"""Registry of named queries: the Spark plan and, where SQL can state it, the
DuckDB oracle over the same driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    operators: str


QUERIES: dict[str, Query] = {}


def register(name: str, operators: str, oracle: str | Callable[[], str] | None = None):
    def deco(fn):
        sql = oracle() if callable(oracle) else oracle
        QUERIES[name] = Query(name, fn, sql, operators)
        return fn
    return deco
