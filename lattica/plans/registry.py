"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None
    headline: bool


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, headline: bool = False) -> Callable[[Build], Build]:
    """Register a plan under its function name."""

    def register(build: Build) -> Build:
        QUERIES[build.__name__] = Query(build.__name__, build, sql, headline)
        return build

    return register
