"""All registered queries with their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with SQL where the operator has one."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import the query modules once and return both tables."""
    from lexatlas.plans import answer_queries, corpus_queries, evaluation_queries, invariant_queries, retrieval_queries, text_queries  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
