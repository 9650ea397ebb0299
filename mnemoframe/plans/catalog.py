"""The registry of queries: a Spark function, its operators and its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from mnemoframe.plans.oracle import with_tables


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    """Register a function under its own name."""
    def register(run):
        CATALOG[run.__name__] = Query(
            run.__name__, operators, run, with_tables(sql) if sql else None)
        return run

    return register


def load() -> dict[str, Query]:
    from mnemoframe.plans import (  # noqa: F401  (each module registers its queries)
        lifecycle_queries,
        report_queries,
        retrieval_queries,
        source_queries,
        stream_queries,
        text_queries,
    )
    return CATALOG
