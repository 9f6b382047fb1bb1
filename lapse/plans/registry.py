"""Registry of named queries: a Spark builder plus, where SQL can say it,
the equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str  # SURVEY ids covered, e.g. "A6"


REGISTRY: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, operators)
        return fn

    return deco
